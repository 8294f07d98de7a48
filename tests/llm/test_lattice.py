from __future__ import annotations

import random

import pytest

from corollary.llm import lattice

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.load_vocabulary(MODEL)


def small(scores):
    byte_ids = tuple(range(1000, 1256))
    return lattice.Vocabulary(tuple((p, i, s) for i, (p, s) in enumerate(scores.items())), byte_ids)


def brute(text, vocabulary):
    """Best score over all segmentations by a plain recursion, ties to the longer last piece."""
    table = {p: (s, i) for p, i, s in vocabulary.pieces}
    text = vocabulary.escaped(text)
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        found = None
        for start in range(max(0, end - vocabulary.longest), end):
            piece = text[start:end]
            if piece in table or end - start == 1:
                score, i = table.get(piece, (vocabulary.unknown_score, None))
                ids = [i] if i is not None else [vocabulary.byte_ids[b] for b in piece.encode()]
                way = (best[start][0] + score, best[start][1] + ids)
                if found is None or way[0] > found[0]:
                    found = way
        best.append(found)
    return best[-1][1]


def test_against_brute_force(spark):
    rng = random.Random(3)
    scores = {"▁": -2.0, "a": -3.0, "b": -3.0, "ab": -4.5, "ba": -4.5, "aba": -6.0, "▁ab": -5.0, "abab": -9.0, "1": -3.0, "11": -6.0, ".": -1.0, "..": -2.0, "▁▁": -9.0}
    vocabulary = small(scores)
    texts = ["".join(rng.choice("aabb1. é") for _ in range(rng.randrange(0, 40))) for _ in range(120)] + ["ab" * 300, "a" * 1000, None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = lattice.encode(frame, vocabulary, block_rows=20).withColumn("back", lattice.decoded("ids", vocabulary)).collect()
    assert len(got) == len(texts)
    for row in got:
        text = texts[row["doc_id"]] or ""
        assert row["ids"] == brute(text, vocabulary) and row["n_ids"] == len(row["ids"]) and row["back"] == text


def test_against_the_library(spark, vocabulary):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = pb.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the same pieces and scores, decoded as a unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = ["Hello world", "thanedble erzu.", "naïve café 12 3,4", "x\ny", "日本", "²."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in lattice.encode(frame, vocabulary).collect():
        assert row["ids"] == library.encode(texts[row["doc_id"]])


def test_round_trip_of_odd_rows(odd, empty, vocabulary):
    got = lattice.encode(odd, vocabulary).withColumn("back", lattice.decoded("ids", vocabulary)).toPandas()
    assert sorted(got.back) == sorted((r["text"] or "") for r in odd.collect())
    assert list(got.columns) == ["doc_id", "ids", "n_ids", "back"]
    assert lattice.encode(empty, vocabulary).count() == 0


def test_lattices_are_no_rows(spark, vocabulary):
    """Shuffles carry texts, distinct units and their ids; no row is made of a substring or an edge."""
    frame = spark.range(40).selectExpr("id doc_id", "concat('unit', id, ' of the corpus') text")
    plan = lattice.encode(frame, vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "BroadcastHashJoin" not in plan


def test_units_return_in_parts(spark, monkeypatch):
    """Equal units of many blocks, packed a few at a time, and characters that are no piece."""
    monkeypatch.setattr(lattice, "PACK_ROWS", 5)
    vocabulary = small({"▁": -2.0, "a": -3.0, "aa": -6.0, "▁a": -5.0, "b": -1.0, "bab": -1.5, "babab": -9.0})
    texts = [f"{'ab' * (i % 7)} aa éa{'b' * (i % 5)} \U0001d11ea" for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["ids"] for r in lattice.encode(frame, vocabulary, block_rows=4).collect()}
    assert got == {i: brute(t, vocabulary) for i, t in enumerate(texts)}
