"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words (with one bin for
all other words) are compared with references of the languages by the Jensen-Shannon distance
(base 2, so 0 to 1). The references are summed over all documents of a language that pass the base
rules. A document counts as prose if it is near to the reference of some language, so mixed
and mislabelled texts are not punished; texts too short for a histogram to mean anything are
not judged by it. How far is too far follows from the data: from the median and the ninth decile of the
distances of all documents that pass the base rules and are long enough.

Everything is column expressions. One pass over the texts makes a narrow table of counts; the
references (one row a language, of a fixed list of languages) and the verdicts come from it.

Defined cases: NULL and empty texts have no words and fail the base rules; repeated rows are
judged each; a language outside the list has a class reference of its own and is not judged by
words; a document without language is judged by the classes of whichever reference is nearest; one
whose language has no reference is not judged by distance. Columns other than id, text and language are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import WORD, let, query, table
from panelweave.session import cut_lineage

# Symbols and base limits. (Fixed values.)
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50  # words, percent

# Frequent function words of each language; together they are the bins of the word histogram. (Fixed values.)
COMMON_WORDS = {
    "de": "auf das dem den der die ein eine einen er es für im in ist mit nicht sich sie und von zu".split(),
    "en": "a and are as at be by for from have he in is it of on or that the this to was with you".split(),
    "es": "con de del el en es la las lo los no para por que se su un una y".split(),
    "fr": "au avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une".split(),
}
BINS = sorted({w for words in COMMON_WORDS.values() for w in words})

# Character classes, counted one after another in what the ones before left; the rest is the last class.
CLASSES = {"lower": r"\p{Ll}+", "upper": r"\p{Lu}+", "space": r"[\x20\x09-\x0D]+", "stop": r"[.,;:!?'\"()-]+", "digit": r"\p{Nd}+", "symbol": r"[#*$%&|<>]+"}

BROADCAST_LANGUAGES = 10_000  # rows of a few numbers each
CLASS_CHARS, WORD_COUNT = 200, 100  # shortest texts judged: characters, words
# A limit lies so many times as far above the median distance as the ninth decile does, and at least at LEAST_LIMIT.
# Word distances spread more, and a text without any common word is not much farther than the ninth decile.
CLASS_SPREADS, WORD_SPREADS, LEAST_LIMIT = 5.0, 2.5, 0.2


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of `width` words found twice or more, each counted once.

    Windows are compared by hash inside the row: sorted with their places, equal neighbours are
    repeats. Rows without any repeat, which is most, stop at the distinct count.
    """
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(width)]))

    def covered(h):
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = let(
            placed,
            lambda s: F.filter(
                s,
                lambda x, i: ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
            ),
        )
        at = F.array_sort(F.transform(same, lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(width), F.get(p, i + 1) - x), F.lit(width))), F.lit(0), lambda a, b: a + b))

    return F.when(n < width + 1, F.lit(0)).otherwise(let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda l: l.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def class_counts(text: Column) -> Column:
    """Characters of each class, in the order of CLASSES, then all others."""

    def step(left: Column, names: list[str], done: list[Column]) -> Column:
        if not names:
            return F.array(*done, F.length(left))
        return let(F.regexp_replace(left, CLASSES[names[0]], ""), lambda rest: step(rest, names[1:], [*done, F.length(left) - F.length(rest)]))

    return step(text, list(CLASSES), [])


def bin_counts(words: Column) -> Column:
    """How often each word of BINS occurs (small letters), trailing stops and commas aside, and how many words are others."""
    bare = F.filter(F.transform(words, lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?"))), lambda w: w.isin(BINS))
    known = lambda b: F.transform(F.array(*[F.lit(w) for w in BINS]), lambda w: F.size(b) - F.size(F.array_remove(b, w)))
    return let(bare, lambda b: F.concat(known(b), F.array(F.size(words) - F.size(b))))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One narrow row for each document: base counts and both histograms."""
    t = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def of(words):
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            bin_counts(words).alias("bins"),
        )

    got = t.select(
        "doc_id",
        "lang",
        let(words_of(F.col("text")), of).alias("w"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        class_counts(F.col("text")).alias("classes"),
    )
    return got.select("doc_id", "lang", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "classes", "w.bins")


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)


def distance(counts: Column, reference: list[float] | Column) -> Column:
    """Jensen-Shannon distance of a histogram from a reference distribution."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)

    def term(p, q):
        m = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (part(p) + part(q)) / 2

    ref = reference if isinstance(reference, Column) else F.array(*[F.lit(float(q)) for q in reference])
    return let(total, lambda n: F.when(n > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(counts, ref, lambda c, q: term(c / n, q)), F.lit(0.0), lambda a, b: a + b)))))


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Class and word shares of each listed language over all rows that pass the base rules.

    As many short rows come back as COMMON_WORDS lists languages, whatever the data.
    """
    good = rows.where(F.col("lang").isin(list(COMMON_WORDS)) & ~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    sums = [F.sum(F.get("classes", i)).alias(f"c{i}") for i in range(len(CLASSES) + 1)] + [F.sum(F.get("bins", i)).alias(f"b{i}") for i in range(len(BINS) + 1)]
    out = {}
    for r in good.groupBy("lang").agg(*sums).collect():
        c = [r[f"c{i}"] for i in range(len(CLASSES) + 1)]
        b = [r[f"b{i}"] for i in range(len(BINS) + 1)]
        if sum(c) and sum(b):
            out[r.lang] = [x / sum(c) for x in c], [x / sum(b) for x in b]
    return dict(sorted(out.items()))


def nearest(counts: Column, refs: list[list[float]]) -> Column:
    """Distance to the nearest of the references; NULL without counts or references."""
    each = [distance(counts, r) for r in refs]
    return F.least(*each) if len(each) > 1 else each[0] if each else F.lit(None).cast("double")


def other_references(rows: DataFrame) -> DataFrame:
    """Rows (ref_lang, ref): class shares of each language outside COMMON_WORDS, over its rows that pass the base rules."""
    good = rows.where(~F.col("lang").isin(list(COMMON_WORDS)) & ~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    sums = good.groupBy(F.col("lang").alias("ref_lang")).agg(F.array(*[F.sum(F.get("classes", i)) for i in range(len(CLASSES) + 1)]).alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, b: a + b)
    return sums.where(total > 0).select("ref_lang", F.transform("c", lambda x: x / total).alias("ref"))


def limit(rows: DataFrame, column: str, spreads: float) -> float:
    """Beyond which distance a document is too far: from the median and the ninth decile of `column`.

    Distances are rounded, so that what is sorted are at most 10001 values.
    """
    q = rows.agg(F.percentile(F.round(column, 4), F.array(F.lit(0.5), F.lit(0.9)))).first()[0]
    return max(LEAST_LIMIT, q[0] + spreads * (q[1] - q[0])) if q else 1.0


def judge(rows: DataFrame) -> DataFrame:
    """The table of `measures` with class_distance, word_distance, base_failed and kept."""
    refs = references(rows)
    columns = [c for c in rows.columns if c not in ("class_distance", "word_distance", "base_failed", "kept")]
    others = cut_lineage(other_references(rows))
    own = F.when(F.col("ref").isNotNull(), distance(F.col("classes"), F.col("ref")))
    every = others.agg(F.collect_list("ref").alias("r"))  # a short row for each language
    rows = rows.select(*columns).join(F.broadcast(others) if others.count() <= BROADCAST_LANGUAGES else others, F.col("lang") == F.col("ref_lang"), "left")
    rows = rows.withColumn("refs", every.scalar())
    unlabelled = F.when(F.col("lang").isNull(), F.array_min(F.transform("refs", lambda r: distance(F.col("classes"), r))))
    rows = rows.withColumn("class_distance", F.least(nearest(F.col("classes"), [c for c, _ in refs.values()]), own, unlabelled))
    rows = rows.withColumn("word_distance", nearest(F.col("bins"), [b for _, b in refs.values()]))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    listed = F.coalesce(F.col("lang").isin(list(refs)), F.lit(False))
    size = F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)
    by_class = (listed | F.col("ref").isNotNull() | F.col("lang").isNull()) & (size >= CLASS_CHARS)
    by_words = listed & (F.col("n_words") >= WORD_COUNT)
    rows = cut_lineage(rows.withColumns({"base_failed": failed, "by_class": by_class, "by_words": by_words}).drop("ref_lang", "ref", "refs"))
    odd = F.lit(False)
    for judged, column, spreads in (("by_class", "class_distance", CLASS_SPREADS), ("by_words", "word_distance", WORD_SPREADS)):
        far = limit(rows.where(~F.col("base_failed") & F.col(judged)), column, spreads)
        odd = odd | F.coalesce(F.col(judged) & (F.round(column, 4) > far), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~odd).drop("by_class", "by_words")


def _sql() -> str:
    """The same verdicts in SQL, from long tables of words, lines and bins."""
    lit = lambda v: "'" + v.replace("'", "''") + "'"
    steps, left = ["k0 AS (SELECT doc_id, lang, text AS t0 FROM d)"], "t0"
    for i, pattern in enumerate(CLASSES.values()):
        steps.append(f"k{i + 1} AS (SELECT *, regexp_replace(t{i}, {lit(pattern)}, '', 'g') AS t{i + 1} FROM k{i})")
        left = f"t{i + 1}"
    n = len(CLASSES)
    sizes = [f"length(t{i}) - length(t{i + 1})" for i in range(n)] + [f"length({left})"]
    classes = " UNION ALL ".join(f"SELECT doc_id, {i} AS bin, {c} AS c FROM k{n}" for i, c in enumerate(sizes))
    langs = ", ".join(map(lit, COMMON_WORDS))
    bins = ", ".join(map(lit, BINS))
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((p + q) / 2)) ELSE 0 END"

    def nearest_sql(name: str) -> str:
        return f"""{name}_n AS (SELECT doc_id, sum(c) AS n FROM {name} GROUP BY 1),
  {name}_r AS (SELECT lang, bin, sum(c) / sum(sum(c)) OVER (PARTITION BY lang) AS q FROM {name} JOIN good USING (doc_id) GROUP BY 1, 2),
  {name}_t AS (SELECT doc_id, lang, c / n AS p, q FROM {name} JOIN {name}_n USING (doc_id) JOIN {name}_r USING (bin) WHERE n > 0),
  {name}_l AS (SELECT doc_id, lang, sqrt(greatest(0.0, sum(({part('p')} + {part('q')}) / 2))) AS js FROM {name}_t GROUP BY 1, 2),
  {name}_d AS (SELECT doc_id, min(js) AS js FROM {name}_l GROUP BY 1)"""

    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM d),
  p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
  g AS (SELECT doc_id, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  rep AS (SELECT doc_id, a, b, c FROM g WHERE c IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) > 1),
  spot AS (SELECT DISTINCT g.doc_id, g.i + k AS i FROM g JOIN rep ON g.doc_id = rep.doc_id AND g.a = rep.a AND g.b = rep.b AND g.c = rep.c, (SELECT unnest([0, 1, 2]) AS k)),
  n3 AS (SELECT doc_id, count(*) AS n FROM spot GROUP BY 1),
  l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
  nw AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM p GROUP BY 1),
  base AS (SELECT d.doc_id, d.lang, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(n3.n, 0) AS n_repeat_words
    FROM d LEFT JOIN nw USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN n3 USING (doc_id)),
  b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base),
  good AS (SELECT doc_id, lang FROM b WHERE NOT base_failed AND lang IN ({langs})),
  {", ".join(steps)},
  cls AS ({classes}),
  {nearest_sql("cls")},
  bn AS (SELECT unnest([{bins}]) AS bin),
  hit AS (SELECT doc_id, rtrim(lower(word), '.,;:!?') AS bin, count(*) AS c FROM p GROUP BY 1, 2),
  known AS (SELECT f.doc_id, f.bin, coalesce(hit.c, 0) AS c FROM (SELECT doc_id, bin FROM d, bn) f LEFT JOIN hit ON hit.doc_id = f.doc_id AND hit.bin = f.bin),
  wrd AS (SELECT * FROM known UNION ALL SELECT doc_id, '', n_words - c FROM (SELECT doc_id, sum(c) AS c FROM known GROUP BY 1) JOIN base USING (doc_id)),
  {nearest_sql("wrd")},
  far AS (SELECT b.*, c.js AS class_distance, x.js AS word_distance, (b.lang IN ({langs}) OR b.lang IS NULL) AND cn.n >= {CLASS_CHARS} AS by_class,
    coalesce(b.lang IN ({langs}), false) AND n_words >= {WORD_COUNT} AS by_words
    FROM b LEFT JOIN cls_d c USING (doc_id) LEFT JOIN wrd_d x USING (doc_id) LEFT JOIN cls_n cn USING (doc_id)),
  lim AS (SELECT quantile_cont(round(class_distance, 4), [0.5, 0.9]) FILTER (by_class) AS c, quantile_cont(round(word_distance, 4), [0.5, 0.9]) FILTER (by_words) AS w FROM far WHERE NOT base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance, base_failed,
  NOT base_failed AND NOT coalesce(by_class AND round(class_distance, 4) > greatest({LEAST_LIMIT}, c[1] + {CLASS_SPREADS} * (c[2] - c[1])), false)
    AND NOT coalesce(by_words AND round(word_distance, 4) > greatest({LEAST_LIMIT}, w[1] + {WORD_SPREADS} * (w[2] - w[1])), false) AS kept
FROM far, lim
"""


@query("op3_quality_divergence", _sql())
def op3_quality_divergence(spark, d):
    out = judge(cut_lineage(measures(table(spark, d, "documents"))))
    digits = [F.round(c, 6).alias(c) for c in ("class_distance", "word_distance")]
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *digits, "base_failed", "kept")

