from __future__ import annotations

import random
import re

from corollary.llm import packing


def brute(lengths, sources, clusters, capacity):
    bins = []
    for n, s, c in zip(lengths, sources, clusters, strict=True):
        fits = [
            (capacity - b["used"], k) for k, b in enumerate(bins)
            if capacity - b["used"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])
        ]
        if fits:
            k = min(fits)[1]
        else:
            bins.append({"used": 0, "s": set(), "c": set()})
            k = len(bins) - 1
        yield k, bins[k]["used"]
        bins[k]["used"] += n
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)


def test_block_is_best_fit():
    rng = random.Random(3)
    for _ in range(20):
        n = rng.randrange(1, 200)
        lengths = sorted((rng.randrange(0, 60) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, "hot", "hot", "a", "b", "c"]) for _ in range(n)]
        clusters = [rng.choice([None, 1, 2, 3, 4, 5, 6, 7]) for _ in range(n)]
        assert list(zip(*packing.pack_block(lengths, sources, clusters, 64), strict=True)) == list(brute(lengths, sources, clusters, 64))


def test_every_word_is_packed_once(odd):
    rows = packing.pack_documents(odd, capacity=100, block_rows=16).toPandas()
    docs = odd.toPandas()
    docs["n"] = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in docs.text]
    assert rows.length.sum() == docs.n.sum()
    assert (rows.groupby("bin").length.sum() <= 100).all()
    for _, b in rows.groupby("bin"):
        at = 0
        for piece in b.sort_values("offset").itertuples():
            assert piece.offset == at or piece.length == 0
            at += piece.length
    # Every document's pieces cover it: starts are multiples of the capacity.
    per_doc = rows.dropna(subset=["doc_id"]).groupby("doc_id").length.sum()
    counted = docs.dropna(subset=["doc_id"]).groupby("doc_id").n.sum()
    assert (per_doc == counted).all()


def test_no_conflict(odd):
    rows = packing.pack_documents(odd, capacity=100, block_rows=1000).toPandas()
    docs = odd.select("doc_id", "source").distinct().toPandas()
    joined = rows[~rows.bin.str.startswith("full")].merge(docs.dropna(), on="doc_id")
    assert not joined.duplicated(["bin", "source"]).any()


def test_empty(empty):
    assert packing.pack_documents(empty).count() == 0
