"""Benchmark decontamination by template windows.

Texts become templates: names, numbers and units of measure are replaced by typed placeholders,
so that a question asked again with other parameters keeps its template. Windows of `WIDTH`
template words of the benchmark items are joined by hash with those of the documents. Matches on
one diagonal (document place minus item place) are one occurrence of the item. An occurrence of
enough windows counts if its slots are consistent: each item value stands for one document value
of its type (units in one spelling); two item values may stand for one document value.

Windows of an item are of three sorts:

* strict: of at least `LITERALS` words that are no placeholders
* loose: all windows of an item with fewer than `ENOUGH` strict ones. An occurrence known by them
  only has to be consistent and to share the whole template or `LITERALS` words with the item
  (an item that would have too few windows without its sentence starts also has all windows
  loose, and those in which capitalised sentence starts are read as names)
* plain: windows of the words themselves. Enough of them are a copy, whatever the slots

Everything is column expressions and joins. A window can only match where all its neighbouring
words are neighbours in an item, or may be placeholders. One cheap reading of a text marks such
pairs; only windows inside runs of them are hashed, and texts without a run are left out (`runs`).
The items' pairs are a table of `BITS` bits for each; a pair that meets another one's bit costs a
useless window, never a result.

Item windows, and the keys of documents whose slots are compared, are broadcast only while their
number is within `BROADCAST_WINDOWS`; beyond that Spark joins by shuffle, with the same rows.

Defined cases: NULL text has no words; an item shorter than a window is one window of all its
words; an item of placeholders only is found by its own values only; rows with one doc_id count as one document in
the report, while `contaminated` tells them apart by their whole row; repeated items are found
each; empty tables give no rows; columns other than ids and texts are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import let, query, row_hash, table
from panelweave.llm.quality import COMMON_WORDS
from panelweave.operators.prefix import null_safe_join
from panelweave.session import cut_lineage

WIDTH = 8  # template words
LITERALS = 6  # of a window, at least
ENOUGH = 5  # windows of an occurrence, or all of a shorter item
BROADCAST_WINDOWS = 1_000_000  # rows of a few numbers each
BITS, TABLE_BITS = 32, 1 << 23  # of the bit table of item words: for each pair, and all in all

NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"  # placeholders, from the private-use area
# Units that follow a number. (Fixed values.)
UNITS = (
    "mm cm m km kg g mg t l ml h min s ms ha mph kb mb gb kw kwh v w hz ft lb lbs oz percent euro euros dollar dollars cent cents pound pounds "
    "hours hour minutes minute seconds second days day weeks week months month years year miles mile feet foot inches inch yards yard "
    "metres metre meters meter kilometres kilometre kilometers kilometer litres litre liters liter grams gram kilograms kilogram tons ton ounces ounce"
).split()

# Spellings of one unit. (Fixed values.)
SPELLINGS = {
    "hours": "h", "hour": "h", "minutes": "min", "minute": "min", "seconds": "s", "second": "s", "days": "day", "weeks": "week", "months": "month", "years": "year",
    "euros": "euro", "dollars": "dollar", "cents": "cent", "miles": "mile", "feet": "ft", "foot": "ft", "inches": "inch", "yards": "yard",
    "metres": "m", "metre": "m", "meters": "m", "meter": "m", "kilometres": "km", "kilometre": "km", "kilometers": "km", "kilometer": "km",
    "litres": "l", "litre": "l", "liters": "l", "liter": "l", "grams": "g", "gram": "g", "kilograms": "kg", "kilogram": "kg", "tons": "t", "ton": "t",
    "pounds": "pound", "lbs": "lb", "ounces": "oz", "ounce": "oz",
}

START = "\ue003"  # mark of a capitalised word that is no name for certain
AFTER_MARKS = "\ue004"
# Words that are no names where a sentence starts. (Fixed values.)
NO_NAMES = sorted({w for words in COMMON_WORDS.values() for w in words if len(w) > 1} | set("if how what when where who why which then there".split()))

_NUMBER = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
# a capital and a small letter behind a word or comma and one space start a name; sentence starts
# do not, nor do words all in capitals
_NAME_START = r"([\p{L}\p{N},;] )(\p{Lu}\p{Ll})"
_CAPITAL = rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}{NAME}])"
_AFTER_NUMBER = r"(?<=\p{Nd})( ?)(?=\p{L})"
_WORD = rf"[{NAME}{UNIT}{START}]?\p{{L}}+|{_NUMBER}"


def bare(text: Column) -> Column:
    """The text without characters that serve as marks; NULL is empty."""
    t = F.coalesce(text, F.lit(""))
    marks = [NAME, NUMBER, UNIT, START]
    held = reduce(or_, [t.contains(m) for m in marks])  # a plain search is cheap, and hardly any text has one
    return F.when(held, F.translate(t, "".join(marks), "")).otherwise(t)


def words_of(text: Column) -> Column:
    """Numbers and words in small letters. A mark stands before names, other capitalised words (START)
    and words behind a number (UNIT)."""
    names = F.regexp_replace(bare(text), _NAME_START, f"$1{NAME}$2")
    marked = F.regexp_replace(F.regexp_replace(names, _CAPITAL, START), _AFTER_NUMBER, f"$1{UNIT}")
    return F.regexp_extract_all(F.lower(marked), F.lit(_WORD), F.lit(0))


def is_number(word: Column) -> Column:
    return (word < ":") | (word >= "\u0660") & F.rlike(word, F.lit(r"^\p{Nd}"))


def plain(word: Column) -> Column:
    """A word of `words_of` without its mark."""
    return F.when((word >= NAME) & (word < AFTER_MARKS), F.substring(word, 2, 10**9)).otherwise(word)


def token(word: Column) -> Column:
    """A word of `words_of` as template word: a placeholder, a literal word, or a possible name with its mark."""
    literal = F.substring(word, 2, 10**9)
    named = F.when(F.startswith(word, F.lit(NAME)), NAME)
    unit = F.when(F.startswith(word, F.lit(UNIT)), F.when(literal.isin(UNITS), UNIT).otherwise(literal))
    start = F.when(F.startswith(word, F.lit(START)) & literal.isin(NO_NAMES), literal)
    marked = (word >= NAME) & (word < AFTER_MARKS)
    return F.when(marked, F.coalesce(named, unit, start, word)).otherwise(F.when(is_number(word), NUMBER).otherwise(word))


def tokens(words: Column) -> Column:
    return F.transform(words, token)


def plain_words(words: Column) -> Column:
    return F.transform(words, plain)


def is_start(word: Column) -> Column:
    return F.startswith(word, F.lit(START))


def literal_start(word: Column) -> Column:
    return F.when(is_start(word), F.substring(word, 2, 10**9)).otherwise(word)


def named_start(word: Column) -> Column:
    return F.when(is_start(word), F.lit(NAME)).otherwise(word)


def template(words: Column) -> Column:
    """`tokens` in which possible names are literal words."""
    return F.transform(words, literal_start)


def renamed(words: Column) -> Column:
    """`tokens` in which possible names are names."""
    return F.transform(words, named_start)


def is_slot(word: Column) -> Column:
    return word.isin(NAME, NUMBER, UNIT)


@dataclass(frozen=True)
class Pairs:
    """The neighbouring words of the items, as a table of bits."""

    bits: str  # 64-bit parts of the table, joined by commas
    size: int  # a power of two
    slots: bool  # may an item's name, number or unit be another one?
    names: bool  # and a capitalised sentence start?

    def holds(self, key: Column) -> Column:
        parts = F.split(F.lit(self.bits), ",").cast("array<bigint>")
        part = F.get(parts, F.shiftright(key.bitwiseAND(self.size - 1), 6).cast("int"))
        return F.call_function("shiftright", part, key.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _pair(first: Column, second: Column) -> Column:
    return first.bitwiseXOR(F.shiftright(second, 5))


def item_pairs(items: DataFrame, names: bool, text_col: str = "text") -> Pairs:
    """Of the items' plain words; `names`: may a capitalised sentence start be a name?

    At most `TABLE_BITS` bits come to the driver, whatever the number of items."""
    m = items.select(words_of(F.col(f"`{text_col}`")).alias("w"))
    m = cut_lineage(m.select(tokens(F.col("w")).alias("t"), F.transform(plain_words(F.col("w")), lambda w: F.xxhash64(w)).alias("h")))
    slots = m.agg(F.max(F.exists("t", is_slot))).first()[0]
    keys = m.select(F.explode(F.transform(F.slice("h", 1, F.greatest(F.lit(0), F.size("h") - 1)), lambda h, i: _pair(h, F.get("h", i + 1)))).alias("k")).distinct()
    size = 1 << min(TABLE_BITS, max(64, BITS * keys.count())).bit_length() - 1
    k = F.col("k").bitwiseAND(size - 1)
    got = keys.groupBy(F.shiftright(k, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))).alias("b")).collect()
    held = {r["at"]: r["b"] for r in got}
    return Pairs(",".join(str(held.get(i, 0)) for i in range(size // 64)), size, bool(slots), names)


def flags(words: Column, pairs: Pairs) -> Column:
    """`+` or `-` for each word but the last one: may it and the next word be neighbours in an item?
    A last `-` makes the flags as many as the words. A word that may be a slot goes with any other."""

    def one(w):
        marked = (w >= (NAME if pairs.slots else START)) & (w < (AFTER_MARKS if pairs.names else START))
        slot = marked | is_number(w) if pairs.slots else marked
        return F.when(~slot, F.xxhash64(plain(w)))

    def of(hs):
        known = lambda h, i: F.coalesce(pairs.holds(_pair(h, F.get(hs, i + 1))), F.lit(True))
        return F.array_join(F.transform(hs, lambda h, i: F.when((i + 1 < F.size(hs)) & known(h, i), "+").otherwise("-")), "")

    return let(F.transform(words, one), of)


def runs(flag: Column) -> Column:
    """First places (from 1) of the windows whose neighbours all have `+`; a text of fewer than WIDTH words is one window."""
    parts = F.regexp_extract_all(flag, F.lit(rf"\+{{{WIDTH - 1},}}|\+*-+"), F.lit(0))
    add = lambda acc, p: F.struct(
        (acc["at"] + F.length(p)).alias("at"),
        F.when(F.startswith(p, F.lit("+" * (WIDTH - 1))), F.concat(acc["found"], F.sequence(acc["at"], acc["at"] + F.length(p) - (WIDTH - 1)))).otherwise(acc["found"]).alias("found"),
    )
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))
    none = F.array().cast("array<int>")
    short = F.when(F.rlike(flag, F.lit(r"^\+*-$")), F.array(F.lit(1))).otherwise(none)
    some = F.when(F.contains(flag, F.lit("+" * (WIDTH - 1))), F.aggregate(parts, start, add, lambda acc: acc["found"])).otherwise(none)
    return F.when(F.length(flag) < WIDTH, short).otherwise(some)


def _starts(words: Column) -> Column:
    """First places (from 1) of the windows of WIDTH words; one if there are fewer words; none if there are none."""
    return F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (WIDTH - 1))))


def windows(words: Column, starts: Column) -> Column:
    """(pos from 0, h) of the windows at `starts`; every word is hashed once."""
    one = lambda x, i: F.struct((i - 1).alias("pos"), F.xxhash64(F.slice(x, i, WIDTH)).alias("h"))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda x: F.transform(starts, lambda i: one(x, i)))


def text_windows(words: Column, starts: Column, names: bool) -> Column:
    """(pos from 0, h, reading) of the windows of `words_of` at `starts`: as template, and, where that is
    another one, of the plain words and with possible names."""
    hashed = lambda ws, fn: F.xxhash64(F.transform(ws, lambda w: F.xxhash64(fn(w))))
    shape = lambda ws: hashed(ws, lambda w: literal_start(token(w)))
    row = lambda i, h, reading: F.struct((i - 1).alias("pos"), h.alias("h"), F.lit(reading).alias("reading"))

    def at(i):
        def of(ws):
            first = row(i, shape(ws), "template")
            others = [row(i, hashed(ws, plain), "plain")] + ([row(i, hashed(ws, lambda w: named_start(token(w))), "names")] if names else [])
            return let(first, lambda t: F.concat(F.array(t), F.filter(F.array(*others), lambda o: o["h"] != t["h"])))

        return let(F.slice(words, i, WIDTH), of)

    return F.flatten(F.transform(starts, at))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item_id, item_pos, h, strict, loose, plain, names, needed, enough, total).

    `needed` are the strict windows of an occurrence, `enough` the windows of the other sorts,
    `total` all windows of the item; `names` are windows with possible names.
    """
    t = items.select(F.col(f"`{id_col}`").alias("item_id"), words_of(F.col(f"`{text_col}`")).alias("m")).distinct()
    t = t.select("item_id", tokens(F.col("m")).alias("tokens"), plain_words(F.col("m")).alias("plain_words"))
    t = t.withColumn("words", template(F.col("tokens"))).where(F.size("words") > 0)
    literal = lambda i: F.size(F.filter(F.slice("words", i, WIDTH), lambda w: ~is_slot(w)))
    t = t.withColumn("says", F.transform(_starts(F.col("words")), lambda i: literal(i) >= F.least(F.lit(LITERALS), F.size("words"))))
    t = t.withColumns({"total": F.size("says"), "n_strict": F.size(F.filter("says", lambda x: x))})
    t = t.withColumns({"ws": windows(F.col("words"), _starts(F.col("words"))), "ps": windows(F.col("plain_words"), _starts(F.col("words")))})
    t = t.withColumn("starts", F.transform(_starts(F.col("words")), lambda i: F.exists(F.slice("tokens", i, WIDTH), is_start)))
    t = t.withColumn("ns", windows(renamed(F.col("tokens")), _starts(F.col("words"))))
    t = t.withColumns({"enough": F.least(F.lit(ENOUGH), "total"), "needed": F.least(F.lit(ENOUGH), "n_strict")})
    w = t.select("item_id", "needed", "enough", "total", "n_strict", (F.size(F.filter("starts", lambda x: ~x)) < F.col("enough")).alias("names"), F.explode(F.arrays_zip("says", "starts", "ws", "ps", "ns")).alias("z"))
    w = w.withColumns({"names": F.col("names") & F.col("z.starts"), "loose": F.col("names") | (F.col("n_strict") < F.col("enough"))})
    w = w.withColumn("same", F.col("z.ws.h") == F.col("z.ps.h"))
    no, yes = F.lit(False), F.lit(True)
    kind = lambda h, strict, loose, plain, names=no: F.struct(h.alias("h"), strict.alias("strict"), loose.alias("loose"), plain.alias("plain"), names.alias("names"))
    both = F.array(kind(F.col("z.ws.h"), F.col("z.says"), F.col("loose"), F.col("same")), kind(F.col("z.ps.h"), no, no, yes))
    renames = F.when(F.col("names"), F.array(kind(F.col("z.ns.h"), no, yes, no, yes))).otherwise(F.slice(both, 1, 0))
    # a template window without slots is its plain window; one that says nothing is not joined
    rows = F.filter(F.concat(F.when(F.col("same"), F.slice(both, 1, 1)).otherwise(both), renames), lambda k: k["strict"] | k["loose"] | k["plain"])
    return w.select("item_id", F.col("z.ws.pos").alias("item_pos"), "needed", "enough", "total", F.explode(rows).alias("k")).select(
        "item_id", "item_pos", "k.*", "needed", "enough", "total"
    )


def _small(written: DataFrame) -> DataFrame:
    """A written table of hashes and numbers, marked for broadcast while it is small."""
    return F.broadcast(written) if written.count() <= BROADCAST_WINDOWS else written


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, row, item_id, shift, n_windows, first_pos, last_pos, sort, total) of occurrences with enough windows.

    `row` is a hash of the whole document row, `shift` the diagonal, positions are the item's;
    `sort` is that of the windows which the occurrence is known by: strict, else plain, else loose.
    """
    wanted = cut_lineage(item_windows(items))
    names = not wanted.where("names").isEmpty()
    pairs = item_pairs(items, names)
    found = let(words_of(F.col(f"`{text_col}`")), lambda ws: let(flags(ws, pairs), lambda f: let(runs(f), lambda at: text_windows(ws, at, names))))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_hash(docs).alias("row"), found.alias("hs"))
    # the outer form, because for the inner one the optimizer adds a filter that reads every text a second time
    at = d.select("doc_id", "row", F.explode_outer("hs").alias("w")).where("w IS NOT NULL").select("doc_id", "row", F.col("w.pos").alias("doc_pos"), F.col("w.h").alias("h"), F.col("w.reading").alias("reading"))
    hits = at.join(_small(wanted), "h")
    sorts = ["strict", "plain", "loose"]
    keys = ["doc_id", "row", "item_id", "needed", "enough", "total", "shift"]
    hits = hits.withColumns({"strict": F.col("strict") & (F.col("reading") == "template"), "loose": F.col("loose") & (F.col("reading") != "plain"), "plain": F.col("plain") & (F.col("reading") != "names")})
    hits = hits.withColumn("shift", F.col("doc_pos") - F.col("item_pos")).groupBy(*keys, "item_pos").agg(*[F.max(k).alias(k) for k in sorts])
    of = lambda k: F.struct(F.count_if(k).alias("n_windows"), F.min(F.when(F.col(k), F.col("item_pos"))).alias("first_pos"), F.max(F.when(F.col(k), F.col("item_pos"))).alias("last_pos"), F.lit(k).alias("sort"))
    found = hits.groupBy(*keys).agg(*[of(k).alias(k) for k in sorts])
    least = {"strict": F.greatest("needed", F.lit(1)), "plain": F.col("enough"), "loose": F.col("enough")}
    best = F.coalesce(*[F.when(F.col(f"{k}.n_windows") >= least[k], F.col(k)) for k in sorts])
    return found.select("doc_id", "row", "item_id", "shift", "total", best.alias("b")).where("b IS NOT NULL").select("doc_id", "row", "item_id", "shift", "b.*", "total")


def consistent(found: DataFrame, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`found` with `n_slots`, `changed` (slots whose value differs) and `consistent`.

    Only occurrences of items that have slots go back to the texts, and none known by plain windows.
    """
    found = cut_lineage(found)
    i = items.select(F.col("item_id"), words_of(F.col("text")).alias("m")).select("item_id", tokens(F.col("m")).alias("it"), plain_words(F.col("m")).alias("iv"))
    i = cut_lineage(i.where(F.exists("it", lambda w: is_slot(w) | is_start(w))).distinct())
    open_ = null_safe_join(found.where("sort <> 'plain'"), i, ["item_id"])
    # possible names are names in loose occurrences only
    open_ = open_.withColumn("it", F.when(F.col("sort") == "loose", renamed(F.col("it"))).otherwise(template(F.col("it")))).distinct()
    spots = F.filter(F.sequence(F.col("first_pos") + 1, F.col("last_pos") + WIDTH), lambda p: is_slot(F.get("it", p - 1)))
    open_ = cut_lineage(open_.withColumn("spots", spots).where(F.size("spots") > 0))
    d = docs.select(F.col(f"`{id_col}`").alias("d_id"), row_hash(docs).alias("d_row"), F.col(f"`{text_col}`").alias("d_text"))
    key = (F.col("row") == F.col("d_row")) & F.col("doc_id").eqNullSafe(F.col("d_id"))
    near = d.join(_small(cut_lineage(open_.select("doc_id", "row").distinct())), key, "left_semi").distinct()
    near = near.withColumn("m", words_of(F.col("d_text"))).select("d_id", "d_row", tokens(F.col("m")).alias("dt"), plain_words(F.col("m")).alias("dv"))
    both = open_.join(near, key).withColumn("dt", F.when(F.col("sort") == "loose", renamed(F.col("dt"))).otherwise(template(F.col("dt"))))
    spelling = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    one = lambda v: F.coalesce(F.element_at(spelling, F.coalesce(v, F.lit(""))), v)
    pair = lambda p: F.struct(F.get("it", p - 1).alias("k"), one(F.get("iv", p - 1)).alias("i"), one(F.get("dv", p - 1 + F.col("shift"))).alias("d"), F.get("dt", p - 1 + F.col("shift")).alias("j"))
    pairs = F.filter(F.transform("spots", pair), lambda x: x["k"] == x["j"])
    both = both.withColumn("pairs", pairs)
    kinds = lambda *f: F.size(F.array_distinct(F.transform("pairs", lambda x: F.struct(*[x[c] for c in f]))))
    shared = F.filter(F.sequence(F.col("first_pos") + 1, F.col("last_pos") + WIDTH), lambda p: ~is_slot(F.get("it", p - 1)) & (F.get("it", p - 1) == F.get("dt", p - 1 + F.col("shift"))))
    guarded = (F.size(shared) >= LITERALS) | (F.size(shared) > 0) & (F.col("n_windows") == F.col("total"))
    one_value = kinds("k", "i") == kinds("k", "i", "d")
    keys = ["doc_id", "row", "item_id", "shift"]
    checked = both.select(*keys, F.size("pairs").alias("n_slots"), F.size(F.filter("pairs", lambda x: x["i"] != x["d"])).alias("changed"), (one_value & ((F.col("sort") == "strict") | guarded)).alias("ok"))
    # items repeated under one id may be read more than once: the best reading counts
    checked = checked.groupBy(*keys).agg(F.max("ok").alias("ok"), F.max("n_slots").alias("n_slots"), F.min("changed").alias("changed"))
    c = checked.select(*[F.col(k).alias(f"c_{k}") for k in keys], "ok", "n_slots", "changed")
    same = F.lit(True)
    for k in keys:
        same = same & (found[k].eqNullSafe(c[f"c_{k}"]) if k.endswith("_id") else found[k] == c[f"c_{k}"])
    f = found.join(c, same, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return f.select(*found.columns, zero("n_slots"), zero("changed"), F.coalesce("ok", F.lit(True)).alias("consistent"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contaminated pairs (doc_id, item_id): most windows of an occurrence, occurrences, and whether
    every occurrence has changed parameters."""
    ok = consistent(occurrences(docs, items), docs, items).where("consistent")
    return ok.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.count(F.lit(1)).alias("n_occurrences"), F.min(F.col("changed") > 0).alias("reparameterised")
    )


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, row) of the document rows that hold an item, broadcast while they are few."""
    return _small(cut_lineage(consistent(occurrences(docs, items), docs, items).where("consistent").select("doc_id", "row").distinct()))


def _sql() -> str:
    """The same report in SQL, with window texts in place of hashes and without runs."""
    slots, quoted = f"('{NAME}', '{NUMBER}', '{UNIT}')", lambda ws: ", ".join(f"'{w}'" for w in ws)
    words = f"regexp_replace(translate(coalesce(text, ''), '{NAME}{NUMBER}{UNIT}{START}', ''), '{_NAME_START}', '\\1{NAME}\\2', 'g')"
    words = f"regexp_replace({words}, '(^|[^\\p{{L}}{NAME}])(\\p{{Lu}}\\p{{Ll}})', '\\1{START}\\2', 'g')"
    words = f"regexp_extract_all(lower(regexp_replace({words}, '(\\p{{Nd}} ?)(\\p{{L}})', '\\1{UNIT}\\2', 'g')), '{_WORD}')"
    token_ = f"""CASE WHEN w[1] = '{NAME}' THEN w[1] WHEN w[1] = '{UNIT}' THEN CASE WHEN w[2:] IN ({quoted(UNITS)}) THEN w[1] ELSE w[2:] END
      WHEN w[1] = '{START}' THEN CASE WHEN w[2:] IN ({quoted(NO_NAMES)}) THEN w[2:] ELSE w END WHEN regexp_matches(w, '^\\p{{Nd}}') THEN '{NUMBER}' ELSE w END"""
    spelled = lambda v: f"CASE {v} {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in SPELLINGS.items())} ELSE {v} END"

    def side(n: str, table_name: str, key: str) -> str:
        part = lambda c: f"list_slice({c}, pos, pos + {WIDTH - 1})"
        return f"""{n}m AS (SELECT DISTINCT {key}, {words} AS ws FROM {table_name}),
  {n}t AS (SELECT {key}, list_transform(ws, lambda w: {token_}) AS tk, list_transform(ws, lambda w: CASE WHEN w[1] IN ('{NAME}', '{UNIT}', '{START}') THEN w[2:] ELSE w END) AS pl FROM {n}m),
  {n}r AS (SELECT {key}, tk, pl, list_transform(tk, lambda w: CASE WHEN w[1] = '{START}' AND length(w) > 1 THEN w[2:] ELSE w END) AS t,
    list_transform(tk, lambda w: CASE WHEN w[1] = '{START}' AND length(w) > 1 THEN '{NAME}' ELSE w END) AS nm FROM {n}t WHERE len(tk) > 0),
  {n}w AS (SELECT *, array_to_string({part('t')}, ' ') AS ht, array_to_string({part('pl')}, ' ') AS hp, array_to_string({part('nm')}, ' ') AS hn, {part('tk')} AS part
    FROM (SELECT *, unnest(range(1, greatest(1, len(tk) - {WIDTH - 1}) + 1)) AS pos FROM {n}r))"""

    of = lambda k: f"count(*) FILTER (WHERE {k}) AS n_{k}, min(pos) FILTER (WHERE {k}) AS lo_{k}, max(pos) FILTER (WHERE {k}) AS hi_{k}"
    pick = lambda c: f"CASE sort WHEN 'strict' THEN {c}_strict WHEN 'plain' THEN {c}_plain ELSE {c}_loose END"
    return f"""
WITH {side('d', 'documents', 'doc_id')},
  {side('i', 'benchmark', 'item_id')},
  said AS (SELECT *, len(list_filter(part, lambda x: x NOT IN {slots})) >= least({LITERALS}, len(tk)) AS says, len(list_filter(part, lambda x: x[1] = '{START}')) > 0 AS starts FROM iw),
  ruled AS (SELECT *, count(*) OVER i AS total, count(*) FILTER (says) OVER i AS n_strict, count(*) FILTER (NOT starts) OVER i AS n_sure FROM said WINDOW i AS (PARTITION BY item_id)),
  named AS (SELECT *, n_sure < least({ENOUGH}, total) AS few FROM ruled),
  kinds AS (SELECT item_id, pos, total, n_strict, ht AS h, says AS strict, few OR n_strict < least({ENOUGH}, total) AS loose, ht = hp AS plain FROM named
    UNION ALL SELECT item_id, pos, total, n_strict, hp, false, false, true FROM named WHERE ht <> hp
    UNION ALL SELECT item_id, pos, total, n_strict, hn, false, true, false FROM named WHERE few AND starts),
  texts AS (SELECT doc_id, pos, 'template' AS reading, ht AS h FROM dw UNION ALL SELECT doc_id, pos, 'plain', hp FROM dw WHERE hp <> ht UNION ALL SELECT doc_id, pos, 'names', hn FROM dw WHERE hn <> ht),
  hits AS (SELECT doc_id, item_id, total, n_strict AS said, t.pos - k.pos AS shift, k.pos, bool_or(strict AND reading = 'template') AS strict, bool_or(loose AND reading <> 'plain') AS loose,
    bool_or(plain AND reading <> 'names') AS plain FROM texts t JOIN kinds k ON t.h = k.h AND (strict OR loose OR plain) GROUP BY 1, 2, 3, 4, 5, 6),
  sums AS (SELECT doc_id, item_id, total, said, shift, {of('strict')}, {of('plain')}, {of('loose')} FROM hits GROUP BY 1, 2, 3, 4, 5),
  sorted AS (SELECT *, CASE WHEN n_strict >= greatest(1, least({ENOUGH}, said)) THEN 'strict' WHEN n_plain >= least({ENOUGH}, total) THEN 'plain' WHEN n_loose >= least({ENOUGH}, total) THEN 'loose' END AS sort FROM sums),
  occ AS (SELECT doc_id, item_id, shift, total, sort, {pick('n')} AS n_windows, {pick('lo')} AS lo, {pick('hi')} AS hi FROM sorted WHERE sort IS NOT NULL),
  spot AS (SELECT *, unnest(range(lo, hi + {WIDTH})) AS p FROM occ WHERE sort <> 'plain'),
  placed AS (SELECT s.*, CASE WHEN sort = 'loose' THEN ir.nm[p] ELSE ir.t[p] END AS k, CASE WHEN sort = 'loose' THEN dr.nm[p + shift] ELSE dr.t[p + shift] END AS j, ir.pl[p] AS i, dr.pl[p + shift] AS d
    FROM spot s JOIN ir ON ir.item_id = s.item_id JOIN dr ON dr.doc_id = s.doc_id WHERE p <= len(ir.tk)),
  pairs AS (SELECT *, k IN {slots} AS slot, {spelled('i')} AS i1, {spelled('d')} AS d1 FROM placed),
  checked AS (SELECT doc_id, item_id, shift, (count(DISTINCT (k, i1)) FILTER (slot AND k = j) = count(DISTINCT (k, i1, d1)) FILTER (slot AND k = j)) AND (any_value(sort) = 'strict'
      OR count(*) FILTER (NOT slot AND k = j) >= {LITERALS} OR count(*) FILTER (NOT slot AND k = j) > 0 AND any_value(n_windows) = any_value(total)) AS ok,
    count(*) FILTER (slot AND k = j AND i1 <> d1) AS changed FROM pairs GROUP BY 1, 2, 3 HAVING count(*) FILTER (slot) > 0)
SELECT occ.doc_id, occ.item_id, max(n_windows) AS n_windows, count(*) AS n_occurrences, bool_and(coalesce(changed, 0) > 0) AS reparameterised
FROM occ LEFT JOIN checked c ON c.doc_id = occ.doc_id AND c.item_id = occ.item_id AND c.shift = occ.shift WHERE coalesce(ok, true) GROUP BY 1, 2
"""


@query("op10_decontaminate", _sql())
def op10_decontaminate(spark, d):
    return report(table(spark, d, "documents"), table(spark, d, "benchmark"))
