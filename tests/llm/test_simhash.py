from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from corollary.llm import simhash
from corollary.llm.components import connected_components


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(codes, distance):
    codes = list(codes)
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def check(rows, got):
    codes = {f"{plain_fingerprint(t or ''):016x}" for _, t in rows}
    groups = brute_groups([int(c, 16) for c in codes], 2)
    least = {}
    for i, t in rows:
        g = groups[plain_fingerprint(t or "")]
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted(((i, f"{plain_fingerprint(t or ''):016x}", least.get(groups[plain_fingerprint(t or "")])) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want


def test_odd_rows(odd):
    check([(r["doc_id"], r["text"]) for r in odd.collect()], simhash.simhash_groups(odd).collect())


@pytest.mark.parametrize("cell_rows", [8, 50, 8192])
def test_near_copies(spark, cell_rows):
    rng = random.Random(4)
    rows = []
    for k in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(25):
            changed = list(words)
            for _ in range(rng.randrange(3)):
                changed[rng.randrange(150)] = f"v{rng.randrange(9)}"
            rows.append((len(rows), " ".join(changed)))
    rng.shuffle(rows)
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), cell_rows=cell_rows).collect()
    check(rows, got)
    assert len({r["component_id"] for r in got}) < 200


def test_index_finds_all_neighbours():
    rng = np.random.default_rng(0)
    codes = np.unique(np.concatenate([rng.integers(0, 2 ** 63, 400).astype(np.uint64), (np.uint64(7 << 40) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))]))
    index = simhash.GrayIndex(codes)
    assert sorted(index.codes) == sorted(codes)
    queries = np.concatenate([codes, rng.integers(0, 2 ** 63, 50).astype(np.uint64)])
    found = {(int(queries[q]), int(index.codes[c])) for qs, cs in index.search(queries, 2) for q, c in zip(qs, cs, strict=True)}
    assert found == {(int(a), int(b)) for a in queries for b in codes if (int(a) ^ int(b)).bit_count() <= 2}


def test_gray_rank_orders_by_single_bits():
    codes = np.arange(64, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert all((int(a) ^ int(b)).bit_count() == 1 for a, b in zip(ordered, ordered[1:], strict=False))


def test_survivors(odd, empty):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    groups = simhash.simhash_groups(odd).toPandas()
    rows = kept.toPandas()
    assert sorted(rows.doc_id.dropna()) == sorted(set(groups.component_id.dropna()))
    assert rows.doc_id.isna().sum() == 0  # both are in a group with documents that have an id
    assert simhash.simhash_groups(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 700)] + [(900, 900), (None, 3), (3, None), (901, 902), (902, 901)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 500 for i in range(500, 700)}, 901: 901, 902: 901}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
