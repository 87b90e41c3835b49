import gzip
import hashlib
import os

from pyspark.sql import functions as F

from oracle_check import compare, connect
from panelweave.llm import warc
from panelweave.llm.queries import ORACLES, QUERIES

PAGE = "page_id long, url string, html string"


def test_query(spark):
    con = connect("/root/testdata/sf0.01")
    ok, said = compare(spark, con, QUERIES["op7_warc_fixity_audit"], ORACLES["op7_warc_fixity_audit"], "/root/testdata/sf0.01")
    assert ok, said


def plain_tree(records):
    """Roots by a direct walk over the records."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = {}
    for a, off, length, dig in sorted(records):
        level.setdefault((a, off // warc.LEAF), []).append(f"{off}:{length}:{dig}")
    level = {k: sha(",".join(v)) for k, v in level.items()}
    for _ in range(warc.LEVELS - 1):
        up = {}
        for (a, n), dig in sorted(level.items()):
            up.setdefault((a, n // warc.FAN_OUT), []).append(f"{n}:{dig}")
        level = {k: sha(",".join(v)) for k, v in up.items()}
    roots = {}
    for (a, n), dig in sorted(level.items()):
        roots.setdefault(a, []).append(f"{n}:{dig}")
    return {a: sha(",".join(v)) for a, v in roots.items()}


def test_tree_and_descent(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAF", 1000)
    pages = spark.createDataFrame([(i, f"http://h/{i}", "text " * (i % 90)) for i in range(2500)], PAGE)
    m = warc.manifest(pages)
    records = [(r.archive, r.offset, r.length, r.digest) for r in m.collect()]
    levels = warc.tree(m)
    assert {r.archive: r.digest for r in levels[-1].collect()} == plain_tree(records)
    assert warc.audit(m, m).count() == 0
    bad = F.col("page_id").isin(0, 777, 2499)
    other = m.withColumn("digest", F.when(bad, F.lit("?")).otherwise(F.col("digest"))).where("page_id <> 1500")
    got = warc.audit(m, other).collect()
    assert sorted((r.left_page, r.right_page) for r in got if r.right_page is not None) == [(0, 0), (777, 777), (2499, 2499)]
    assert [r.left_page for r in got if r.right_page is None] == [1500]
    gone = warc.audit(m, m.where("archive <> 1"))
    assert gone.count() == 1000 and gone.where("right_page is not null").count() == 0


def test_written_files_are_warc(spark, tmp_path, monkeypatch):
    """Files are WARC, in order, and read back as the manifest that was meant, whatever the html holds."""
    monkeypatch.setattr(warc, "PAGES", 30)
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    html = lambda i: [f"<p>é {i}\r\n\r\nx</p>", "\r\n\r\n", None, "", f"x\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc{i}"][i % 5]
    pages = spark.createDataFrame([(i, f"http://h/{i}", html(i)) for i in range(100)] + [(None, "u", "x")], PAGE)
    warc.write_archives(pages, str(tmp_path / "w"))
    found = 0
    for folder, _, names in os.walk(tmp_path / "w"):
        for name in names:
            if name.startswith("part-"):
                data = gzip.decompress(open(os.path.join(folder, name), "rb").read())
                records = list(warc.parse(data))
                assert records[-1][0] + records[-1][1] == len(data) and len(records) <= 7
                for at, length, digest, _ in records:
                    assert data[at:].startswith(b"WARC/1.0\r\n") and data[at : at + length].endswith(b"\r\n\r\n") and digest == hashlib.sha256(data[at : at + length]).hexdigest()
                found += len(records)
    assert found == 101
    rows = lambda m: sorted(map(tuple, m.select("archive", "page_id", "offset", "length", "digest").collect()), key=repr)
    assert rows(warc.read_manifest(spark, str(tmp_path / "w"))) == rows(warc.manifest(pages))


def test_lengths_that_change_move_what_follows(spark):
    """A longer record, a lost one and an added one: only these are reported, what moved is not."""
    rows = [(i, f"http://h/{i}", "text " * (i % 90)) for i in range(1500)]
    other = [(i, u, h + "!" if i == 40 else h) for i, u, h in rows if i != 700] + [(1499, "http://new", "more")]
    left, right = warc.replica(spark.createDataFrame(rows, PAGE)), warc.replica(spark.createDataFrame(other, PAGE))
    got = sorted(((r.left_page, r.right_page, r.left_offset, r.right_offset) for r in warc.audit(left, right).collect()), key=repr)
    place = {r.page_id: r.offset for r in left.collect()}
    assert sorted((a, b) for a, b, *_ in got if a is not None and b is not None) == [(40, 40)]
    assert [(a, x) for a, b, x, y in got if b is None] == [(700, place[700])]
    assert [b for a, b, *_ in got if a is None] == [1499]
    moved = {r.page_id: r.offset for r in right.where("page_id < 1499").collect()}
    assert moved[41] == place[41] + 1 and moved[1000] == place[1000]  # the next archive starts anew


def test_descent_is_a_short_plan(spark):
    m = warc.manifest(spark.createDataFrame([(i, f"u{i}", "x") for i in range(50)], PAGE))
    plan = warc.audit(m, m.where("page_id <> 3"))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange") < 40


def test_unreadable_bytes():
    good = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    assert [(a, n, p) for a, n, _, p in warc.parse(good + b"noise")] == [(0, len(good), 5), (len(good), 5, None)]
    assert [(a, n, p) for a, n, _, p in warc.parse(good[:-3])] == [(0, len(good) - 3, 5)]
    assert list(warc.parse(b"")) == []


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, "x"), (1, "u", None), (1, "u", None), (2, "", ""), (3, "u", "x" * 1_000_000)]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], PAGE + ", offset long, digest string")
    m = warc.manifest(pages)
    assert m.count() == 6 and m.agg(F.count_distinct("archive", "offset")).first()[0] == 5
    assert warc.audit(m, m).count() == 0
    assert warc.audit(m, m.where("length < 1000")).count() == 1
    none = warc.manifest(spark.createDataFrame([], PAGE))
    assert warc.audit(none, none).count() == 0 and warc.audit(m, none).count() == 6 - 0
