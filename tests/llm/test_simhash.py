import random
import re

import numpy as np
import pytest
import xxhash

from panelweave.llm import simhash
from panelweave.llm.queries import QUERIES


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pieces = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [least[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t", "One", "One Two", "a b c", "a b c a b c a", "É e\x1fx ÀB c", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    codes = np.unique(np.concatenate([base, near]))
    index = simhash.GrayIndex(codes)
    got = set(zip(*(x.tolist() for x in index.search(index.codes))))
    d = np.bitwise_count(index.codes[:, None] ^ index.codes)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(d <= 3))))


def test_every_close_pair_shares_a_node():
    rng = random.Random(2)
    for level in (1, 2, 3):
        for m in simhash._level_masks(level - 1)[:40]:
            free = [b for b in range(64) if not m >> b & 1]
            for _ in range(20):
                flip = sum(1 << b for b in rng.sample(free, 3))
                assert any(not flip & s for s in simhash.masks(m))
    assert max(64 - m.bit_count() for m in simhash._level_masks(3)) <= 15


@pytest.mark.parametrize("node_rows", [4096, 8])
def test_links_at_every_node_size(spark, node_rows):
    """Small nodes force the second and third level; components stay those of all pairs."""
    rng = random.Random(3)
    codes = {rng.getrandbits(64) for _ in range(40)}
    for c in list(codes)[:12]:  # dense clusters and chains
        for _ in range(25):
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            codes.add(c)
    codes = sorted(codes)
    fps = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(fps, node_rows)).collect()}
    got = [root.get(simhash._signed(c), simhash._signed(c)) for c in codes]
    want = brute_components(list(range(len(codes))), codes)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    want = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(docs, fps, brute_components([r.doc_id for r in docs], fps))}
    assert {tuple(r) for r in QUERIES["op4_simhash_near_duplicates"](spark, d).collect()} == want


def test_odd_rows(odd_documents, no_documents, clashing):
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd_documents).collect()]
    assert len(got) == odd_documents.count()
    assert {c for d, c in got if d in (1, 2, 3)} == {1} and {c for d, c in got if d == 6} == {5}
    assert simhash.near_duplicates(no_documents).count() == 0
    assert simhash.near_duplicates(clashing, key="fp_key").count() == 6
