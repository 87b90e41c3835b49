import re

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle_check import compare, connect
from panelweave.llm import decontaminate as dc
from panelweave.llm.queries import ORACLES, QUERIES

ITEM = "A train leaves the station with Anna at 12 km and then slows down before the bridge so that Anna waits 3 hours for the bus to reach the town."
BRIDGE = "The old bridge over the river was closed for many weeks after the flood came down from the hills."
PROSE = "Nothing of this sort is told here, since the writer wanted to speak of other matters altogether and did so at length without any pause."


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "Five words are too few"), (5, "Bob 1 2 3 4 5 6 7 8 9 10"), (6, BRIDGE)], "item_id long, text string")


def found(documents, items, texts):
    docs = documents([(i, t) for i, t in enumerate(texts)])
    return {(r.doc_id, r.item_id): r for r in dc.report(docs, items).collect()}


def test_copies_and_changed_parameters(documents, items):
    other = ITEM.replace("Anna", "Zed").replace("12", "7.5").replace("3 ", "44 ").replace("km", "mm")
    mixed_up = ITEM.replace("Anna at", "Zed at")  # the same person under two names
    split = ITEM.split(" so that ")[0]  # a part of the item
    got = found(documents, items, [PROSE, PROSE + " " + ITEM, PROSE + " " + other + " " + PROSE, PROSE + " " + mixed_up, split, ITEM + "\n" + other])
    assert set(got) == {(1, 1), (2, 1), (4, 1), (5, 1)}
    assert not got[1, 1].reparameterised and got[2, 1].reparameterised
    assert got[5, 1].n_occurrences == 2 and not got[5, 1].reparameterised


def test_short_items(documents, items):
    got = found(documents, items, ["five words are too few", "so, five words are too few"])
    assert set(got) == {(0, 4)}


def test_capitals_and_other_stops(documents, items):
    got = found(documents, items, [PROSE + " " + BRIDGE.upper(), ITEM.replace(" and", ", and -").replace(".", "!")])
    assert set(got) == {(0, 6), (1, 1)}


def test_both_join_ways(documents, items, monkeypatch):
    texts = [PROSE, ITEM, PROSE + " " + ITEM.replace("12", "99")]
    a = found(documents, items, texts)
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", -1)
    assert found(documents, items, texts) == a


def plain(docs, items):
    """Whole-word search of items that have no slots."""
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    out = set()
    for d in docs:
        grams = {}
        w = words(d.text)
        for p in range(len(w) - 7):
            grams.setdefault(tuple(w[p : p + 8]), []).append(p)
        for i in items:
            v = words(i.text)
            hits = {}
            for q in range(len(v) - 7):
                for p in grams.get(tuple(v[q : q + 8]), []):
                    hits.setdefault(p - q, set()).add(q)
            if any(len(h) >= min(5, len(v) - 7) for h in hits.values()):
                out.add((d.doc_id, i.item_id))
    return out


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_decontaminate"](spark, d).collect()}
    assert got == plain(docs, items)
    ok, said = compare(spark, connect(d), QUERIES["op10_decontaminate"], ORACLES["op10_decontaminate"], d)
    assert ok, said


def twin_agrees(spark, docs, items, folder):
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", items)):
        df.coalesce(1).write.parquet(str(folder / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder / name}/*.parquet')")
    ok, said = compare(spark, con, lambda s, _: dc.report(docs, items), ORACLES["op10_decontaminate"], "")
    assert ok, said


def test_sql_twin_with_slots(spark, documents, items, tmp_path):
    """The SQL agrees on names, numbers and units too."""
    other = ITEM.replace("Anna", "Zed").replace("12", "7.5").replace("3 ", "44 ").replace("km", "mm")
    docs = documents([(0, PROSE), (1, PROSE + " " + ITEM), (2, other + " " + PROSE), (3, PROSE + " " + ITEM.replace("Anna at", "Zed at")), (4, ITEM + "\n" + other)])
    twin_agrees(spark, docs, items, tmp_path)


def test_sql_twin_on_all_sorts_of_windows(spark, documents, tmp_path):
    """Items dense in slots, copies, names at sentence starts, unit spellings, texts shorter than a window."""
    names = ["Maria", "Peter", "Anna", "It", "The", "Bob"]
    made = [DENSE, "Solve 3 x + 5 = 20 for x.", "What is 12 times 17?", "1 2 3 4 5 6 7 8 9 10 11 12", BOXES.format(3, 5), DRIVE.format("2 hours", "3 hours"), MARIA.format("Maria"), BRIDGE, "Five words are too few", "One", ""]
    items = spark.createDataFrame(list(enumerate(made)), "item_id long, text string")
    texts = list(made)
    for i, name in enumerate(names):
        texts += [MARIA.format(name), PROSE + " " + MARIA.format(name) + " " + BOXES.format(i, 5), DENSE.replace("John", name).replace("60", str(i)), DRIVE.format(f"{i} hour", f"{i + 1} min")]
    texts += [DENSE.replace("does John Smith", "does Paul Black"), DENSE.lower(), "7 7 8 8 9 9 1 1 2 2 3 3", BRIDGE.upper(), DRIVE.format("2 weeks", "3 feet"), DRIVE.format("4hours", "4\nhours"), "\ue000Anna \ue003 " + BRIDGE, None]
    twin_agrees(spark, documents(list(enumerate(texts))), items, tmp_path)


def test_runs_spare_windows(spark, documents):
    """Windows of a text are hashed only where neighbouring words could be an item's."""
    items = spark.createDataFrame([(1, BRIDGE)], "item_id long, text string")
    pairs = dc.item_pairs(items, False)
    docs = documents([(0, PROSE), (1, PROSE + " " + BRIDGE + " " + PROSE), (2, "too few"), (3, "old bridge"), (4, ""), (5, None)])
    words = dc.words_of(F.col("text"))
    got = {r.doc_id: (list(r.at), r.n) for r in docs.select("doc_id", dc.runs(dc.flags(words, pairs)).alias("at"), F.size(words).alias("n")).collect()}
    n = len(PROSE.split())
    assert got[0][0] == [] and got[2][0] == [] and got[3][0] == [1] and got[4][0] == got[5][0] == []
    inside = range(n + 1, n + 1 + len(BRIDGE.split()) - 7)
    assert set(inside) <= set(got[1][0]) and len(got[1][0]) <= len(inside) + 3
    for i in range(6):
        assert all(1 <= p <= max(1, got[i][1] - 7) for p in got[i][0])


def test_null_item_ids(spark, documents):
    """Slots of an item without id are compared too."""
    items = spark.createDataFrame([(None, ITEM)], "item_id long, text string")
    docs = documents([(0, ITEM.replace("12", "13")), (1, ITEM.replace("Anna at", "Zed at"))])
    assert [(r.doc_id, r.item_id) for r in dc.report(docs, items).collect()] == [(0, None)]


def test_odd_rows(spark, odd_documents, no_documents, clashing, items):
    assert dc.report(odd_documents, items).count() == 0
    assert dc.report(no_documents, items).count() == 0
    assert dc.report(clashing, items).count() == 0
    assert dc.contaminated(odd_documents, items.where("false")).count() == 0
    twice = odd_documents.unionByName(spark.createDataFrame([(8, ITEM, "en", "s", 1)] * 2, odd_documents.schema))
    assert [r.doc_id for r in dc.contaminated(twice, items).collect()] == [8]  # one kind of row of three with this id


DENSE = "If John Smith drives 60 km in 2 h, how far does John Smith drive in 5 h?"


def test_items_dense_in_slots(spark, documents):
    """Items without a window of six literal words are found as copies and with other parameters, not by their shape alone."""
    solve, ask, counts = "Solve 3 x + 5 = 20 for x.", "What is 12 times 17?", "1 2 3 4 5 6 7 8 9 10 11 12 13 14"
    items = spark.createDataFrame([(1, DENSE), (2, solve), (3, ask), (4, counts)], "item_id long, text string")
    other = DENSE.replace("John Smith", "Mary Jones").replace("60", "75").replace("5 h", "9 h")
    two_people = other.replace("does Mary Jones", "does Paul Black")
    texts = [PROSE + " " + DENSE, DENSE + " " + PROSE, PROSE + " " + other, PROSE + " " + two_people, solve, ask, PROSE + " " + counts, "7 7 8 8 9 9 1 1 2 2 3 3 4 4 5 5 6 6", DENSE.lower(), PROSE]
    got = found(documents, items, texts)
    assert set(got) == {(0, 1), (1, 1), (2, 1), (4, 2), (5, 3), (6, 4), (8, 1)}
    assert got[2, 1].reparameterised and not got[0, 1].reparameterised


BOXES = "The clerk at the counter packed {} boxes of apples in the morning and then {} boxes of pears late in the day for the shop."
DRIVE = "The clerk at the counter waited {} for the first van to come and then {} more for the second van to be there."
MARIA = "{} buys a loaf of fresh bread at the shop every morning."


def test_values_that_may_meet(spark, documents):
    """Two item values may get one value, units have spellings, and names start sentences."""
    two_names = "Later on the teacher asked {} to bring the book and the teacher told {} to read the whole book aloud."
    rows = [(1, BOXES.format(3, 5)), (2, DRIVE.format("2 hours", "3 hours")), (3, MARIA.format("Maria")), (4, two_names.format("Anna", "Anna"))]
    items = spark.createDataFrame(rows, "item_id long, text string")
    texts = [BOXES.format(4, 4), DRIVE.format("1 hour", "3 hours"), PROSE + " " + MARIA.format("Peter"), two_names.format("Zed", "Bob"), MARIA.format("Nobody else ever")]
    assert set(found(documents, items, texts)) == {(0, 1), (1, 2), (2, 3)}
