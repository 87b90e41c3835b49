"""WARC archives and their Merkle fixity audit.

Pages become WARC records laid out one after another in archives: `write_archives` writes one
folder of records for each archive, in order, and `read_manifest` reads such a replica back as
records with their offsets, lengths and digests, all taken from its own bytes. Each record is
hashed; the hashes of the records that start in one offset range make a leaf, and ranges of
`FAN_OUT` times the size make the nodes above, up to one root an archive. Two replicas are compared
by their roots. Only archives whose roots differ are read further, level by level below
nodes that differ, down to the records. Everything is a grouped hash or a join on node numbers.

Replicas are text files of Spark's own writer with the end of a record as line end; a page whose
html holds that end itself is put together again by its Content-Length.

Defined cases: NULL url or html is empty text; pages are laid out by (page_id, url, html hash),
NULL first, and repeated rows get records of their own; a page_id of NULL lies in archive NULL;
an archive that one replica lacks differs at its root and all its records are reported; empty
tables give no rows. Columns other than the three named are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import query, table
from panelweave.operators.prefix import null_safe_join, spread_scan
from panelweave.session import cut_lineage, fresh_path

PAGES = 1000  # page numbers of an archive
FILE_RECORDS = 2000  # of a file, at most
MANIFEST = "archive long, page_id long, offset long, length long, digest string"
LEAF = 1 << 18  # bytes of a leaf's offset range
FAN_OUT = 16
LEVELS = 3  # of ranges below the root: LEAF, LEAF * 16, LEAF * 256


def record(url: Column, html: Column, page_id: Column) -> Column:
    """A WARC/1.0 response record: header, blank line, block and the two line ends behind it."""
    block = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
        block,
        F.lit("\r\n\r\n"),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write `pages` as compressed WARC files, a folder of files in order for each archive."""
    order = ["archive", "page_id", "url_hash", "html_hash"]
    r = record(F.col("url"), F.col("html"), F.col("page_id"))
    rows = pages.select("page_id", F.xxhash64("url").alias("url_hash"), F.xxhash64("html").alias("html_hash"), r.alias("r")).withColumn("archive", F.floor(F.col("page_id") / PAGES))
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the writer's line end is the end of a record
    laid.select(F.expr("left(r, length(r) - 4)").alias("value"), "archive").write.partitionBy("archive").option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(path)


def parse(data: bytes) -> Iterator[tuple[int, int, str, int | None]]:
    """(offset, length, digest, page) of the records in the bytes of a file, by their Content-Length.

    What cannot be read as a record is one with no page, up to the end."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        fields = dict(line.split(b": ", 1) for line in data[at : max(at, head)].split(b"\r\n")[1:] if b": " in line)
        size, page = fields.get(b"Content-Length", b""), fields.get(b"WARC-Record-ID", b"")[10:-1]
        end = head + 4 + int(size) + 4 if head >= 0 and size.isdigit() else len(data)
        yield at, min(end, len(data)) - at, hashlib.sha256(data[at:end]).hexdigest(), int(page) if page.lstrip(b"-").isdigit() else None
        at = end


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows (archive, page_id, offset, length, digest) of a replica, all read from its own files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract("path", r"archive=(\d+|-\d+)/", 1).alias("archive"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, file, content in zip(*(c.to_pylist() for c in batch.columns)):
                found = list(parse(gzip.decompress(content)))
                n = len(found)
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.string(), pa.int64()))] if n else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([int(archive) if archive else None] * n, pa.int64()), pa.array([file] * n, pa.string()), *columns], names=["archive", "file", "at", "length", "digest", "page_id"])

    records = cut_lineage(files.mapInArrow(run, "archive long, file string, at long, length long, digest string, page_id long"))
    sizes = records.groupBy("archive", "file").agg(F.sum("length").alias("bytes"))
    starts = spread_scan(sizes, ["archive"], [F.col("file").asc()], {"before": ("sum", F.col("bytes"), "before")})
    placed = null_safe_join(records, starts.select("archive", "file", "before"), ["archive", "file"], plain=("file",))
    return cut_lineage(placed.select("archive", "page_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("offset"), "length", "digest"))


def replica(pages: DataFrame) -> DataFrame:
    """Write `pages` as archives in the shared folder and read their manifest back."""
    path = fresh_path(pages.sparkSession, "archives")
    write_archives(pages, path)
    if pages.sparkSession.read.text(path).isEmpty():
        return pages.sparkSession.createDataFrame([], MANIFEST)
    return read_manifest(pages.sparkSession, path)


def manifest(pages: DataFrame) -> DataFrame:
    """The manifest that `pages` should have, without writing them; the html itself is not shuffled."""
    r = record(F.col("url"), F.col("html"), F.col("page_id"))
    rows = pages.select("page_id", "url", "html", r.alias("record")).select(
        F.floor(F.col("page_id") / PAGES).alias("archive"),
        "page_id",
        F.xxhash64("url").alias("url_hash"),
        F.xxhash64("html").alias("html_hash"),
        F.octet_length("record").cast("long").alias("length"),
        F.sha2(F.col("record"), 256).alias("digest"),
    )
    order = [F.col("page_id").asc(), F.col("url_hash").asc(), F.col("html_hash").asc()]
    placed = spread_scan(rows, ["archive"], order, {"end": ("sum", F.col("length"), "upto")})
    return placed.select("archive", "page_id", (F.col("end") - F.col("length")).alias("offset"), "length", "digest")


def _joined_hash(order: list[str], digest: str) -> Column:
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(digest).alias("digest"))))
    return F.sha2(F.array_join(F.transform(parts, lambda p: F.concat_ws(":", *[p[o] for o in order], p["digest"])), ","), 256)


def tree(records: DataFrame) -> list[DataFrame]:
    """Tables (archive, node, digest) from the leaves (level 0) to the root (the last).

    A leaf holds the records of one range, which its bytes bound; a node holds FAN_OUT children
    at most and a root the ranges of the top level.
    """
    leaf = records.groupBy("archive", F.floor(F.col("offset") / LEAF).alias("node")).agg(_joined_hash(["offset", "length"], "digest").alias("digest"))
    levels = [cut_lineage(leaf)]
    for _ in range(LEVELS - 1):
        below = levels[-1]
        up = below.groupBy("archive", F.floor(F.col("node") / FAN_OUT).alias("up")).agg(_joined_hash(["node"], "digest").alias("digest"))
        levels.append(up.withColumnRenamed("up", "node"))
    levels.append(levels[-1].groupBy("archive").agg(_joined_hash(["node"], "digest").alias("digest")).withColumn("node", F.lit(0).cast("long")))
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digest differs or that one side lacks."""
    x = a.select(*keys, F.col("digest").alias("da"), F.lit(None).cast("string").alias("db"))
    y = b.select(*keys, F.lit(None).cast("string").alias("da"), F.col("digest").alias("db"))
    both = x.unionByName(y).groupBy(*keys).agg(F.max("da").alias("da"), F.max("db").alias("db"))
    return both.where(~F.col("da").eqNullSafe(F.col("db")))


def audit(left: DataFrame, right: DataFrame, left_tree: list[DataFrame] | None = None, right_tree: list[DataFrame] | None = None) -> DataFrame:
    """Records of `left` and `right` (manifests) that do not agree.

    Rows (archive, left_offset, right_offset, left_page, right_page, left_digest, right_digest), a
    missing side NULL. The descent finds the leaves that differ; in them, what lies at an equal
    place with equal bytes agrees, and what only moved (the same bytes and page at another place,
    because something before it changed its length) is no corruption. What is left of a page
    on both sides is one changed record, in the order of places.
    """
    a, b = left_tree or tree(left), right_tree or tree(right)
    bad = cut_lineage(_differing(a[-1], b[-1], ["archive"]).select("archive"))
    for i in range(len(a) - 2, -1, -1):
        shrink = [F.floor(F.col("node") / FAN_OUT).alias("up")] if i < len(a) - 2 else []
        keys = ["archive", *(["up"] if shrink else [])]
        inside = lambda t: null_safe_join(t.select("*", *shrink), bad, keys, "left_semi", plain=("up",))
        bad = cut_lineage(_differing(inside(a[i]), inside(b[i]), ["archive", "node"]).select("archive", F.col("node").alias("up")))
    leaf = F.floor(F.col("offset") / LEAF).alias("up")
    at = lambda t: null_safe_join(t.select("*", leaf), bad, ["archive", "up"], "left_semi", plain=("up",)).drop("up")
    held = at(left).withColumn("side", F.lit("l")).unionByName(at(right).withColumn("side", F.lit("r")))
    one = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    count = lambda side: F.count(F.when(F.col("side") == side, 1))
    odd = held.groupBy("archive", "page_id", "length", "digest").agg(count("l").alias("l"), count("r").alias("r")).where("l <> r")
    odd = null_safe_join(held, odd, ["archive", "page_id", "length", "digest"], "left_semi", plain=("length", "digest"))
    odd = spread_scan(odd, ["archive", "page_id", "side"], [F.col("offset").asc(), F.col("digest").asc()], {"rank": ("sum", F.lit(1), "upto")})
    return odd.groupBy("archive", "page_id", "rank").agg(
        *[one(s, c).alias(f"{n}_{c2}") for c, c2 in (("offset", "offset"), ("page_id", "page"), ("digest", "digest")) for s, n in (("l", "left"), ("r", "right"))]
    ).drop("page_id", "rank")


# Decay of the replica that the query audits: of page numbers, (divisor, remainder).
FLIPPED, LOST = (101, 7), (997, 5)


def decayed() -> Column:
    """What a decayed replica holds instead of html: here and there one character replaced by two, in the middle."""
    half = F.floor(F.length("html") / 2).cast("int")
    flipped = F.concat(F.substring("html", F.lit(1), half), F.lit("?!"), F.substring("html", half + 2, F.length("html")))
    return F.when(F.col("page_id") % FLIPPED[0] == FLIPPED[1], flipped).otherwise(F.coalesce("html", F.lit("")))


_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR)
 || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
 || 'Content-Length: ' || CAST(strlen({0}) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || {0} || chr(13) || chr(10) || chr(13) || chr(10)"""
_PLACE = "CAST(sum(coalesce(strlen({0}), 0)) OVER (PARTITION BY page_id // 1000 ORDER BY page_id) - strlen({0}) AS BIGINT)"

OP7_SQL = f"""
WITH p AS (SELECT page_id, url, html, CASE WHEN page_id % 997 = 5 THEN NULL WHEN page_id % 101 = 7
    THEN substring(html, 1, length(html) // 2) || '?!' || substring(html, length(html) // 2 + 2) ELSE html END AS kept FROM pages),
r AS (SELECT page_id, {_RECORD.format('html')} AS a, {_RECORD.format('kept')} AS b FROM p),
l AS (SELECT page_id, page_id // 1000 AS archive, a, b, {_PLACE.format('a')} AS left_offset, {_PLACE.format('b')} AS right_offset FROM r)
SELECT archive, left_offset, right_offset, page_id AS left_page, CASE WHEN b IS NOT NULL THEN page_id END AS right_page,
  sha256(a) AS left_digest, sha256(b) AS right_digest
FROM l WHERE b IS NULL OR a <> b
"""


@query("op7_warc_fixity_audit", OP7_SQL)
def op7_warc_fixity_audit(spark, d):
    """Write the archives of `pages` and a decayed copy of them, read both back and audit one against the other."""
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    lost = F.coalesce(F.col("page_id") % LOST[0] == LOST[1], F.lit(False))
    return audit(replica(pages), replica(pages.where(~lost).withColumn("html", decayed())))
