from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from corollary.llm import alignment
from corollary.llm.queries import ALIGNED, QUERIES

SCHEMA = "doc_id long, text string, row long, doc string, radix int, n int, base long, pairs string, groups string"


@pytest.fixture(scope="module")
def files():
    return alignment.Vocabularies.read(*ALIGNED)


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(ALIGNED[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ALIGNED[1])


def byte_char(c: str) -> int:
    """The byte that a character of the byte-level alphabet stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return ord(c) if ord(c) in plain else [b for b in range(256) if b not in plain][ord(c) - 256]


def plain(texts, tokenizers) -> list[dict]:
    """Every link of every document, by the text of the contract."""
    a, b = tokenizers
    cache: dict[int, bytes] = {}

    def a_bytes(i):
        if i not in cache:
            cache[i] = bytes(byte_char(c) for c in a.id_to_token(i))
        return cache[i]

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    out, links, count = [], [], Counter()
    for text in texts:
        line, own = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups": ""}, Counter()
        if text:
            raw = (" " + text).encode()
            ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
            parts = [[f(i) for i in side] for f, side in zip((a_bytes, b_bytes), ids, strict=True)]
            if all(b"".join(p) == raw for p in parts):
                ends = [list(np.cumsum([len(t) for t in p])) for p in parts]
                spelled, at = [], [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    stop = [e.index(cut) + 1 for e in ends]
                    group = [side[x:y] for side, x, y in zip(ids, at, stop, strict=True)]
                    ca, cb = Counter(group[0]), Counter(group[1])
                    for x, n in ca.items():
                        for y, m in cb.items():
                            own[x, y] += n * m
                    spelled.append("|".join(",".join(map(str, g)) for g in group))
                    at = stop
                line = {"n_a": len(ids[0]), "n_b": len(ids[1]), "n_groups": len(spelled), "n_links": sum(own.values()), "groups": ";".join(spelled)}
        count.update(own.keys())
        links.append(own)
        out.append(line)
    best: dict[int, int] = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for line, own in zip(out, links, strict=True):
        line["n_best"] = sum(m for p, m in own.items() if count[p] == best[p[0]])
        line["count_sum"] = sum(m * count[p] for p, m in own.items())
    return out


def odd_texts() -> list[str | None]:
    rng = random.Random(3)
    some = ["the", "unbelievable", "étion", "日本語", "zxqj", "<|endoftext|>", "1234567", "\n\n", "  ", "\t", "ß", "🙂🙂", "x" * 40, "don't", "\x00"]
    texts = [None, "", " ", "a", " lead", "trail ", "x" * 5000, " " * 3000 + "x", "日本" * 300, "<s> <unk> <0x41>", "▁ gone", "qzxj" * 500]
    texts += [rng.choice([" ", "", "  "]).join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return texts + texts[3:8] + ["the the the"] * 20


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, 1, "d", 2, 3, 4, "p", "g") for i, t in enumerate(texts)], SCHEMA).repartition(4)


def as_dict(df):
    return {r["doc_id"]: {c: r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")} for r in df.collect()}


@pytest.mark.parametrize("sizes", [{}, {"radixes": 3, "run_links": 50, "heavy_links": 40, "group_records": 60, "least_records": 1}])
def test_against_every_link(spark, files, tokenizers, sizes):
    texts = odd_texts()
    got, want = as_dict(alignment.align(rows_of(spark, texts), files, **sizes)), plain(texts, tokenizers)
    for i, line in enumerate(want):
        assert got[i] == line, (i, texts[i])
    assert sum(w["n_a"] == 0 for w in want) < 25


def test_whole_table(spark, tokenizers):
    import pandas as pd

    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([t if isinstance(t, str) else None for t in docs.text], tokenizers)
    got = {r["doc_id"]: r for r in QUERIES["op13_alignment"](spark, "/root/testdata/sf0.001").collect()}
    for doc_id, line in zip(docs.doc_id, want, strict=True):
        groups = line.pop("groups")
        assert got[doc_id]["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert {c: got[doc_id][c] for c in line} == line


def test_empty_table_and_repeated_ids(spark, files):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.align(empty, files).collect() == []
    rows = [(None, "one two"), (7, "one two"), (7, "one two"), (7, None)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), files).collect()
    assert sorted((r["doc_id"] is None, r["n_links"], r["count_sum"]) for r in got) == [(False, 0, 0), (False, 2, 6), (False, 2, 6), (True, 2, 6)]


def test_runs_merge_in_order():
    rng = np.random.default_rng(1)
    runs, want = [], Counter()
    for _ in range(7):
        pairs = np.unique(rng.integers(0, 40, 200) * 100 + rng.integers(0, 50, 200))
        n = rng.integers(1, 9, len(pairs))
        want.update(dict(zip(pairs.tolist(), n.tolist(), strict=True)))
        raw = alignment.packed(np.diff(pairs // 100, prepend=0), pairs % 100, n)
        runs.append(alignment.pairs_of(raw))
    got = [(a * 100 + b, n) for a, ids, counts in alignment.merged(runs) for b, n in zip(ids.tolist(), counts.tolist(), strict=True)]
    assert got == sorted(want.items())
    wide = [np.array([1 << 40, 3]), np.array([0, 1])]
    assert all((x == y).all() for x, y in zip(alignment.unpacked(alignment.packed(*wide), 2), wide, strict=True))
