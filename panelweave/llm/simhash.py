"""SimHash near-duplicates by a Gray-order hierarchical index.

A text's fingerprint has a bit set where more than half of its shingle hashes have it. Two
fingerprints link at `BITS` or fewer differing bits, and components of links are duplicates.

How the links are found, exactly, without comparing all pairs:

* The upper nodes are masked bit patterns. 64 bits fall into five blocks; fingerprints that
  differ in at most three bits agree on two whole blocks at least, so each fingerprint is
  filed under the ten patterns that keep two blocks, and only members of one pattern are compared.
* Below an upper node the members are sorted by Gray rank, so that neighbours share most bits.
  Groups of eight form nodes, each with the bits all its members share less those its parent
  has factored out already. A search adds the differences on its way down and drops a whole
  group when the sum passes the bound.
* A node with more than `NODE_ROWS` members is not searched but filed again, by five blocks of
  the bits its pattern leaves free. After three levels at most 15 bits are free, so no node
  holds more than 2^15 fingerprints, whatever the data.
* A node yields links to one member of each component it sees (fewer links than members), never
  its pairs. Components are then joined by rounds of grouped minima over written link tables.

Defined cases: NULL text counts as no words (fingerprint zero), like any text without words;
repeated rows come back repeated; `component_id` is NULL only if all ids in the component are.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import by_batch, query, row_hash, table
from panelweave.session import cut_lineage

BITS = 3  # largest number of differing bits of a link
SHINGLE = 3  # words
SEED = 42
NODE_ROWS = 4096
FAN_OUT = 8
ALL = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of `text`, repeats included (ASCII case folded)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        pieces = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: len(words) - shingle].tolist()]
        pieces = [joined[a : b - 1] for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(p, SEED) for p in pieces]), np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        votes += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """One row (id, fp as signed long) per row; with `key` also a hash of all columns under that name."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *([row_hash(docs).alias(key)] if key else []))
    keep = ["doc_id", *([key] if key else [])]

    def one(cols):
        fp = np.array([fingerprint(t) for t in cols["text"]], np.uint64).view(np.int64)
        return {**{k: cols[k] for k in keep}, "fp": fp}

    return by_batch(rows, ", ".join(f"{k} bigint" for k in [*keep, "fp"]), one)


def _blocks(free: int, n: int = 5) -> list[int]:
    """Split the set bits of `free` into n near-equal runs."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in part) for part in np.array_split(np.array(bits, object), n)]


def masks(fixed: int = 0) -> list[int]:
    """Patterns that fix two of five blocks of the bits not fixed yet."""
    return [fixed | a | b for a, b in combinations(_blocks(ALL & ~fixed), 2)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Hierarchy over distinct fingerprints in Gray order."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes))]
        ones, any_ = self.codes, self.codes
        levels = [(np.full(len(ones), ALL, np.uint64), ones)]  # a leaf shares all its bits
        while len(levels[-1][0]) > 1:
            starts = np.arange(0, len(ones), FAN_OUT)
            ones, any_ = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(any_, starts)
            levels.append((~(ones ^ any_), ones))
        self.levels = []  # from the top: (bits factored out here, their values)
        for i, (mask, value) in enumerate(levels):
            if i + 1 < len(levels):
                mask = mask & ~np.repeat(levels[i + 1][0], FAN_OUT)[: len(mask)]
            self.levels.insert(0, (mask, value))

    def search(self, queries: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
        """(query number, position in `codes`) of all pairs within `bits`."""
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        diff = np.zeros(len(queries), np.int64)
        for depth, (mask, value) in enumerate(self.levels):
            if depth:  # to the children
                q, diff = np.repeat(q, FAN_OUT), np.repeat(diff, FAN_OUT)
                node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                inside = node < len(mask)
                q, node, diff = q[inside], node[inside], diff[inside]
            diff = diff + np.bitwise_count((queries[q] ^ value[node]) & mask[node])
            near = diff <= bits
            q, node, diff = q[near], node[near], diff[near]
        return q, node

    def stars(self, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
        """Links (member, smallest linked member by rounds) that connect what pairs within `bits` connect."""
        n = len(self.codes)
        root = np.arange(n)
        step = max(1, (1 << 21) // n)
        for at in range(0, n, step):
            q, x = self.search(self.codes[at : at + step], bits)
            a, b = root[q + at], root[x]
            while True:  # join the components of the pairs of this block
                lo, hi = np.minimum(a, b), np.maximum(a, b)
                if (lo == hi).all():
                    break
                np.minimum.at(root, hi, lo)
                while not np.array_equal(root, up := root[root]):
                    root = up
                a, b = root[a], root[b]
        own = np.flatnonzero(root != np.arange(n))
        return self.codes[own], self.codes[root[own]]


def _file(fps: DataFrame, level: int) -> DataFrame:
    """Rows (mask, pattern, fp): each fingerprint below its upper nodes of this level."""
    if level == 1:
        m = F.explode(F.array(*[F.lit(_signed(x)) for x in masks()]))
    else:
        sub = {x: masks(x) for x in _level_masks(level - 1)}
        pairs = [F.when(F.col("mask") == F.lit(_signed(x)), F.array(*[F.lit(_signed(y)) for y in ys])) for x, ys in sub.items()]
        m = F.explode(F.coalesce(*pairs))
    return fps.select("fp", m.alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")


def _level_masks(level: int) -> list[int]:
    out = [0]
    for _ in range(level):
        out = sorted({y for x in out for y in masks(x)})
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _search_nodes(filed: DataFrame, limit: int | None) -> DataFrame:
    """Links (a, b) of all upper nodes; members of nodes above `limit` come back with b NULL and their mask.

    Rows arrive sorted by node, so that a task holds one node at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(parts):
            codes = np.concatenate(parts)
            if len(codes) < 2:
                return None
            a, b = GrayIndex(codes.view(np.uint64)).stars()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], names=["a", "b", "mask"]) if len(a) else None

        def pass_on(mask, codes):
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.nulls(len(codes), pa.int64()), pa.array(np.full(len(codes), mask))], names=["a", "b", "mask"])

        node, parts, held, over = None, [], 0, False
        for batch in batches:
            mask, pattern, fp = (batch.column(i).to_numpy() for i in range(3))
            if not len(fp):
                continue
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if node != (this := (mask[at], pattern[at])):
                    if held > 1 and not over and (out := links(parts)) is not None:
                        yield out
                    node, parts, held, over = this, [], 0, False
                parts.append(fp[at:to])
                held += to - at
                if limit and held > limit:
                    over = True
                    yield from (pass_on(mask[at], p) for p in parts)
                    parts = []
        if held > 1 and not over and (out := links(parts)) is not None:
            yield out

    dealt = filed.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return dealt.mapInArrow(run, "a bigint, b bigint, mask bigint")


def links(fps: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` whose components are those of all pairs within BITS."""
    out, rows = None, fps
    for level in (1, 2, 3):
        found = cut_lineage(_search_nodes(_file(rows, level), node_rows if level < 3 else None))
        here = found.where(F.col("b").isNotNull()).select("a", "b")
        out = here if out is None else out.unionByName(here)
        rows = found.where(F.col("b").isNull()).select(F.col("a").alias("fp"), "mask").distinct()
        if level == 3 or rows.isEmpty():
            return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node reachable.

    Rounds of large-star and small-star: every node points its larger (then smaller) neighbours
    at the smallest node it sees. Each round is a written table; the edges never leave the executors.
    """
    smaller, larger = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    e = cut_lineage(edges.select(larger, smaller).where("hi <> lo").distinct())
    last = None
    while True:
        # large star: each node's larger neighbours join its smallest neighbour
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: each node and its smaller neighbours join the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        e = cut_lineage(small)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == last:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        last = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """Every row's doc_id, fp, component_id; with `key` also the hash and `root`, which tells
    components apart where different texts share an id."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, key))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    root = components(links(distinct.select("fp")))
    labelled = distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    label = cut_lineage(labelled.join(least, "root").select("fp", "component_id", "root"))
    return rows.join(label, "fp", "left").select(*[c for c in rows.columns if c != "fp"], "fp", "component_id", *(["root"] if key else []))


@query("op4_simhash_near_duplicates")
def op4_simhash_near_duplicates(spark, d):
    out = near_duplicates(table(spark, d, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
