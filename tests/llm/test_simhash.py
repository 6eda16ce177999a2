import re

import numpy as np
import xxhash

from cladeframe.llm import simhash as S
from cladeframe.llm.components import components


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints_and_components(docs, texts):
    fps, ids = [brute_fp(t) for _, t in texts], [i for i, _ in texts]
    want = sorted((str(i), f, str(c)) for i, f, c in zip(ids, fps, brute_components(fps, ids), strict=True))
    for kwargs in ({}, {"chunk": 4}, {"cell": 1}):
        rows = S.near_duplicates(docs, **kwargs).collect()
        assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in rows) == want


def test_cell_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(0)
    for n in (30, 300, 1500):
        c = rng.integers(0, 2**63, 12).astype(np.uint64)
        near = c[rng.integers(0, 12, n)]
        for _ in range(3):
            near = near ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        x = np.unique(np.concatenate([near, rng.integers(0, 2**63, n).astype(np.uint64)]))
        g = x.copy()
        for k in (1, 2, 4, 8, 16, 32):
            g ^= g >> np.uint64(k)
        x = x[np.argsort(g)]
        got = S.cell_links(x, 4)
        assert len(got) < len(x)

        def named(pairs, size):
            parent = list(range(size))

            def find(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for a, b in pairs:
                parent[find(a)] = find(b)
            first = {}
            return [first.setdefault(find(i), i) for i in range(size)]

        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
        assert named(got, len(x)) == named(zip(i.tolist(), j.tolist(), strict=True), len(x))


def test_blocks_find_every_pair_within_the_bound():
    for m in (5, 6, 7):
        masks = [x & (1 << 64) - 1 for x in S.block_masks(m, 4)]
        rng = np.random.default_rng(m)
        for _ in range(200):
            flips = rng.choice(64, 4, replace=False)
            diff = sum(1 << int(b) for b in flips)
            assert any(diff & mask == 0 for mask in masks)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(50)) and got[2001] == 2000


def test_one_of_each_group_stays(docs, texts, no_docs):
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    fps, ids = [brute_fp(t) for _, t in texts], [i for i, _ in texts]
    want = {i for i, c in zip(ids, brute_components(fps, ids), strict=True) if i == c}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(x for x in want if x is not None)
    assert S.keep_one(no_docs).count() == 0 and S.near_duplicates(no_docs).count() == 0
