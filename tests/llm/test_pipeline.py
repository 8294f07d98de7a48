"""Every stage of the pipeline on the documents that the stage before has kept, against brute force."""

from __future__ import annotations

import re

import corpus_pipeline
from tests.llm.test_linededup import brute
from tests.llm.test_quality import counts
from tests.llm.test_secret_scan import base
from tests.llm.test_simhash import brute_groups, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = out.collect() if name == "best_fit_packing" else docs.collect()

    texts = {name: {r["doc_id"]: r["text"] for r in rows} for name, rows in kept.items() if name != "best_fit_packing"}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n_words, *_, n_repeat = counts(r["text"] or "")
        if n_words < 50 or 2 * n_repeat > n_words:
            assert r["doc_id"] not in texts["quality_rules"]
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    assert not bad & set(texts["quality_rules"])

    gone = brute(list(texts["quality_rules"].items()), 80, 1)
    for i, text in texts["quality_rules"].items():
        left = [line for k, line in enumerate(text.split("\n")) if k not in gone.get(i, ())]
        assert texts["line_dedup"][i] == "\n".join(left)

    codes = {i: plain_fingerprint(t or "") for i, t in texts["line_dedup"].items()}
    groups = brute_groups(set(codes.values()), 2)
    first = {}
    for i, code in sorted(codes.items()):
        first.setdefault(groups[code], i)
    assert set(texts["near_duplicates"]) == set(first.values())

    assert set(texts["secret_scan"]) == set(texts["near_duplicates"])
    for i, text in texts["near_duplicates"].items():
        if not base(text):
            assert texts["secret_scan"][i] == text
        else:
            assert "[SECRET]" in texts["secret_scan"][i] and not base(texts["secret_scan"][i].replace("[SECRET]", " "))

    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts["secret_scan"].values())
    assert sum(r["length"] for r in kept["best_fit_packing"]) == words


def test_columns_of_any_name(spark, labels):
    """Names that the operators use themselves are carried along."""
    names = ["__id", "__key", "__removed", "__lines", "__quality", "__found", "__base", "__spans", "__others", "id", "text_", "row", "fp", "root", "key", "n"]
    text = "\n".join(f"line {i} holds words of its own number {i * 7} and more of them here" for i in range(9))
    rows = [(i, f"{text}\nlast {i} password = abcdef{i}z", *(f"{c}{i}" for c in names)) for i in range(3)] + [(None, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in names)]))
    for stage in (
        lambda d: corpus_pipeline.quality.drop_low_quality(d, labels, threshold=-100.0), corpus_pipeline.linededup.remove_similar_lines,
        corpus_pipeline.simhash.drop_near_duplicates, corpus_pipeline.secret_scan.redact_secrets,
    ):
        out = stage(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert r["doc_id"] is None or all(r[c] == f"{c}{r['doc_id']}" for c in names)


def test_documents_that_share_an_id(spark):
    """Different texts under one id both stay, equal rows and texts without an id are one."""
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, one, "b"), (1, two, "a"), (1, one, "a"), (1, one, "a"), (2, one, "c"), (None, three, "x"), (None, three, "x"), (None, two, "y")]
    out = corpus_pipeline.simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["text"][:4]) for r in out) == [(0, "gamm"), (1, "alph"), (1, "beta")]
    again = corpus_pipeline.simhash.drop_near_duplicates(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
