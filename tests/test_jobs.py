from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corollary import (
    evaluate_hypotheses,
    evaluate_pairs,
    generate_hypotheses,
    generate_pair_hypotheses,
    interpret_sae,
    train_sae,
)
from corollary.functions.text import text_key
from corollary.operators import jobs
from corollary.operators.sampling import SamplingConfig
from corollary.plans import rules
from corollary.session import ship_package
from corollary.sources import stores, tables


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def texts_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")


class Logged:
    """A model that notes every input in a folder, one file per call."""

    def __init__(self, folder, fn):
        self.folder, self.fn = str(folder), fn

    def __call__(self, batch):
        import uuid

        Path(self.folder, uuid.uuid4().hex).write_text("\n".join(b.replace("\n", " ") for b in batch))
        return self.fn(batch)

    def inputs(self):
        return [line for f in Path(self.folder).iterdir() for line in f.read_text().split("\n")]


def test_embedding_job_skips_what_is_stored(spark, tmp_path):
    (tmp_path / "log").mkdir()
    model = Logged(tmp_path / "log", rules.embed_words)
    store = stores.embedding_store(str(tmp_path / "store"), "words")
    first = jobs.embed_texts(texts_of(spark, "a b", "a b", " ", None, "c"), model, store=store, model="nomic-ai/x")
    assert sorted(r.text for r in first.collect()) == ["a b", "c"]
    assert sorted(model.inputs()) == ["search_document: a b", "search_document: c"]
    second = jobs.embed_texts(texts_of(spark, "c", "d"), model, store=store, batch_size=1, partitions=2)
    assert sorted(r.text for r in second.collect()) == ["c", "d"]
    assert sorted(model.inputs()) == ["d", "search_document: a b", "search_document: c"]
    assert store.files(spark).agg(F.sum("rows")).first()[0] == 3
    vector = store.read(spark).filter("text = 'c'").first().embedding
    assert np.isclose(np.linalg.norm(vector), 1.0)
    assert stores.embedding_store(str(tmp_path / "store"), "other").read(spark).count() == 0


def test_instruction_models_get_pairs(spark):
    def pairs(batch):
        assert all(isinstance(x, list) and x[0].startswith("Represent") for x in batch)
        return rules.embed_words([t for _, t in batch])

    got = jobs.embed_texts(texts_of(spark, "a b", "c"), pairs, model="hkunlp/instructor-xl").collect()
    want = dict(zip(("a b", "c"), rules.embed_words(["a b", "c"]), strict=True))
    assert {r.text: r.embedding for r in got} == {t: [float(np.float32(x)) for x in v] for t, v in want.items()}


def test_failing_model_is_tried_again(spark, tmp_path):
    flag = tmp_path / "failed"

    def flaky(batch):
        if not flag.exists():
            flag.touch()
            raise RuntimeError("busy")
        return rules.embed_words(batch)

    assert jobs.embed_texts(texts_of(spark, "a"), flaky).count() == 1

    def wrong(batch):
        return []

    with pytest.raises(Exception, match="0 answers"):
        jobs.embed_texts(texts_of(spark, "a"), wrong)


def data_files(store, listed=None):
    return [Path(store.root, "data", f.file) for f in listed]


def test_a_bad_file_is_named_and_its_keys_asked_again(spark, tmp_path):
    (tmp_path / "log").mkdir()
    model = Logged(tmp_path / "log", rules.embed_words)
    store = stores.embedding_store(str(tmp_path / "store"), "words")
    texts = texts_of(spark, *(f"text {i}" for i in range(60)))
    jobs.embed_texts(texts, model, store=store)
    listed = store.snapshot(spark)
    damaged, gone = data_files(store, listed)[:2]
    damaged.write_bytes(b"not parquet")
    gone.unlink()
    lost = listed[0].rows + listed[1].rows
    assert store.verify(spark).filter("NOT intact").count() == 2
    with pytest.warns(UserWarning, match=damaged.name):
        assert store.read(spark).count() == 60 - lost
    before = len(model.inputs())
    with pytest.warns(UserWarning):
        assert jobs.embed_texts(texts, model, store=store).count() == 60
    assert len(model.inputs()) - before == lost
    # a file with other content than was written, but as many rows
    swapped = data_files(store, listed)[2]
    rows = spark.read.parquet(str(swapped)).withColumn("text", F.lit("other"))
    rows.coalesce(1).write.parquet(str(tmp_path / "other"))
    swapped.write_bytes(next((tmp_path / "other").glob("*.parquet")).read_bytes())
    Path(swapped.parent, f".{swapped.name}.crc").unlink()
    assert [r["file"] for r in store.verify(spark).filter("NOT intact AND found_rows > 0").collect()] == [listed[2].file]


def test_an_unfinished_commit_does_not_count(spark, tmp_path):
    store = stores.annotation_store(str(tmp_path / "store"), "x")
    folder = Path(store.root, "data", "commit=broken", "bucket=a")
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_bytes(b"not parquet")
    assert store.read(spark).count() == 0


def digest_rows(spark, *numbers, value=1):
    keys = spark.createDataFrame([(f"t{i}",) for i in numbers], "text string")
    return keys.select(F.lit("c").alias("concept"), text_key(F.col("text")).alias("text_key"), F.lit(value).alias("value"))


def test_a_wanted_key_opens_only_its_files(spark, tmp_path):
    store = stores.annotation_store(str(tmp_path / "store"), "x")
    for part in range(4):
        store.append(digest_rows(spark, *range(part * 200, part * 200 + 200)))
    every = store.snapshot(spark)
    assert len(every) >= 4 * 14 and sum(f.rows for f in every) == 800
    wanted = digest_rows(spark, 3, 650).select("text_key")
    files = store.snapshot(spark, wanted)
    buckets = {r.text_key[0] for r in wanted.collect()}
    assert {f.bucket for f in files} <= buckets and 2 <= len(files) <= 4
    read = store.read(spark, wanted)
    assert read.count() == 2 and len(read.inputFiles()) <= 4
    assert store.snapshot(spark, digest_rows(spark, 5000).select("text_key")) in ([], *[[f] for f in every])
    plan = store.read(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_a_commit_leaves_out_what_others_hold(spark, tmp_path):
    store = stores.annotation_store(str(tmp_path / "store"), "x")
    store.append(digest_rows(spark, 1, 2))
    before = store.snapshot(spark)
    store.append(digest_rows(spark, 3, 4), snapshot=before)
    store.append(digest_rows(spark, 4, 5, value=0), snapshot=before)  # another run, which began at the same time
    assert sorted((r.value, r.text_key) for r in store.read(spark).collect()) == sorted(
        (v, r.text_key) for v, ids in ((1, (1, 2, 3, 4)), (0, (5,))) for r in digest_rows(spark, *ids).collect()
    )
    store.append(digest_rows(spark, 6), commit="named")
    store.append(digest_rows(spark, 7), commit="named")
    assert store.read(spark).count() == 6


def test_commits_published_at_once_are_made_unique(spark, tmp_path, monkeypatch):
    store = stores.annotation_store(str(tmp_path / "store"), "x")
    store.append(digest_rows(spark, 1, 2))
    listed = store.snapshot(spark)
    monkeypatch.setattr(stores.Store, "snapshot", lambda self, spark, wanted=None: listed)
    store.append(digest_rows(spark, 3, 4))
    store.append(digest_rows(spark, 2, 4, 5))
    monkeypatch.undo()
    assert store.files(spark).agg(F.sum("rows")).first()[0] == 6
    assert store.read(spark).count() == 5


def test_bloom_filters():
    import hashlib

    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    made = stores.bloom_filter(keys[:1000])
    assert all(stores.may_hold(made, [k]) for k in keys[:1000])
    assert sum(stores.may_hold(made, [k]) for k in keys[1000:]) < 60
    assert not stores.may_hold(stores.bloom_filter([]), keys) and not stores.may_hold(made, [])


def test_annotation_job(spark, tmp_path):
    (tmp_path / "log").mkdir()

    def answer(batch):
        return ["hm" if "unclear" in p.rpartition("TEXT")[2] else a for p, a in zip(batch, rules.answer_contains(batch))]

    model = Logged(tmp_path / "log", answer)
    store = stores.annotation_store(str(tmp_path / "store"), "eval")
    tasks = spark.createDataFrame(
        [("red house", "contains: red"), ("red house", "contains: red"), ("red house", "contains: blue"), ("unclear", "contains: red")],
        "text string, concept string",
    )

    def run():
        return {(r.concept, r.text_key): r.value for r in jobs.annotate(tasks, model, store=store).collect()}

    keys = {t: tasks.filter(F.col("text") == t).select(text_key(F.col("text"))).first()[0] for t in ("red house", "unclear")}
    want = {("contains: red", keys["red house"]): 1, ("contains: blue", keys["red house"]): 0, ("contains: red", keys["unclear"]): None}
    assert run() == want
    calls = len([line for line in model.inputs() if "ANSWER" in line])
    assert calls == 2 + jobs.MAX_TRIES
    assert run() == want  # only the unanswered task is asked again
    assert len([line for line in model.inputs() if "ANSWER" in line]) == calls + jobs.MAX_TRIES
    assert store.read(spark).count() == 2


def test_one_bad_prompt_does_not_spoil_its_batch(spark):
    def answer(batch):
        if any("poison" in p for p in batch):
            raise RuntimeError("refused")
        return rules.answer_contains(batch)

    tasks = texts_of(spark, "a poison", "a b", "c").select("text", F.lit("contains: a").alias("concept")).coalesce(1)
    keyed = tasks.select("text", text_key(F.col("text")).alias("text_key"))
    got = {r.text: r.value for r in jobs.annotate(tasks, answer).join(keyed, "text_key").collect()}
    assert got == {"a poison": None, "a b": 1, "c": 0}


def test_annotate_all_uses_the_store(spark, tmp_path):
    (tmp_path / "log").mkdir()
    model = Logged(tmp_path / "log", rules.answer_contains)
    store = stores.annotation_store(str(tmp_path / "store"), "eval")
    texts = texts_of(spark, "x y", "x y", "z")

    def run(concepts):
        found = jobs.annotate_texts_with_concepts(texts, concepts, model, store=store)
        return sorted((r.row_id, r.concept, r.value) for r in found.collect())

    assert run(["contains: x"]) == [(0, "contains: x", 1), (1, "contains: x", 1), (2, "contains: x", 0)]
    asked = len(model.inputs())
    both = run(["contains: x", "contains: z"])
    assert both == sorted([(i, "contains: x", int(i < 2)) for i in range(3)] + [(i, "contains: z", int(i == 2)) for i in range(3)])
    assert asked == 2 and len(model.inputs()) == asked + 2  # two distinct texts, one concept at a time


def test_similarity(spark):
    pairs = spark.createDataFrame([("a b", "a b"), ("a b", "b c d"), ("a", "z")], "text_a string, text_b string")
    got = {(r.text_a, r.text_b): r.similarity for r in jobs.surface_similarity(pairs, rules.grade_overlap, n_samples=3).collect()}
    assert got == {("a b", "a b"): 1.0, ("a b", "b c d"): 0.5, ("a", "z"): 0.0}
    silent = jobs.surface_similarity(pairs, lambda batch: ["?"] * len(batch)).collect()
    assert {r.similarity for r in silent} == {None}


def test_names_of_dead_features_and_failed_candidates(spark):
    texts = texts_of(spark, "red fox", "blue sky", "red sun")
    acts = spark.createDataFrame([(0, 0, 1.0), (2, 0, 2.0), (1, 2, 1.0)], "row_id long, neuron_idx int, activation double")

    def complete(batch):
        if any("blue sky" in p.partition("== OFF ==")[0] for p in batch):
            raise RuntimeError("no answer")
        return rules.name_by_word(batch)

    config = jobs.InterpretConfig(sampling=SamplingConfig(n_examples=4), n_candidates=2, batch_size=1)
    got = sorted(map(tuple, jobs.interpret_neurons(texts, acts, [0, 1, 2], complete, config).collect()))
    assert got == [(0, 0, "contains: red"), (0, 1, "contains: red"), (1, 0, None), (2, 0, None)]


def test_custom_template_and_classes(spark):
    examples = spark.createDataFrame(
        [(0, 2, 1, 5.0, "top"), (0, 1, 2, 1.0, "mid"), (0, 0, 3, 0.0, "none")],
        "neuron_idx int, class int, row_id long, activation double, text string",
    )
    prompt = jobs.naming_prompts(examples, "{class_2_texts}/{positive_texts}/{negative_texts}", None).first().prompt
    assert prompt == "top/mid/none"


class Failing:
    """A model that fails on one text."""

    def __init__(self, word):
        self.word = word

    def __call__(self, batch):
        if any(self.word in t for t in batch):
            raise RuntimeError("model is down")
        return rules.embed_words(batch)


def test_failed_run_goes_on_with_its_first_open_round(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "PAUSE", 0.0)
    (tmp_path / "log").mkdir()
    texts = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "row_id long, text string")
    store = stores.embedding_store(str(tmp_path / "store"), "run")
    keys = texts.select(F.xxhash64(text_key(F.col("text"))).alias("h"), "text").collect()
    last = max(keys, key=lambda r: r["h"] % 4)["text"]  # asked in the last of four rounds
    with pytest.raises(Exception, match="model is down"):
        jobs.embed_texts(texts, Failing(last), store=store, round_rows=10)
    done = store.read(spark).count()
    assert 0 < done < 40
    folders = [p for p in Path(store.root, "work").iterdir()]
    assert len(folders) == 1 and folders[0].name.endswith("-of-4") and len(list(folders[0].glob("round=*"))) == 4
    read = []
    plain = jobs._Work.read
    monkeypatch.setattr(jobs._Work, "read", lambda self, spark, i, schema: (read.append(i), plain(self, spark, i, schema))[1])
    model = Logged(tmp_path / "log", rules.embed_words)
    assert jobs.embed_texts(texts, model, store=store, round_rows=10).count() == 40
    assert len(model.inputs()) == 40 - done
    assert read[0] == 3 and not list(Path(store.root, "work").iterdir())
    assert jobs.embed_texts(texts, Failing(last), store=store, round_rows=10).count() == 40


def test_a_round_reads_its_own_files(spark, tmp_path):
    store = stores.embedding_store(str(tmp_path / "store"), "run")
    tasks = spark.range(500).select(text_key(F.col("id").cast("string")).alias("text_key"))
    work = jobs._Work(store, "job", 5)
    work.write(tasks)
    parts = [work.read(spark, i, tasks.schema) for i in range(5)]
    for i, part in enumerate(parts):
        assert part.inputFiles() and all(f"/round={i}/" in f for f in part.inputFiles())
    assert sum(p.count() for p in parts) == 500


def test_failed_annotation_goes_on(spark, tmp_path, monkeypatch):
    """Unclear answers of rounds that were done before a failure are asked again as well."""
    (tmp_path / "log").mkdir()
    store = stores.annotation_store(str(tmp_path / "store"), "run")
    texts = texts_of(spark, *(f"text {i} a" for i in range(30)), "hm")
    answer = lambda batch: ["hm" if "hm" in p.rpartition("TEXT")[2] else a for p, a in zip(batch, rules.answer_contains(batch))]
    plain, calls = stores.Store.append, []

    def failing(self, rows, **options):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("disk full")
        return plain(self, rows, **options)

    monkeypatch.setattr(stores.Store, "append", failing)
    concepts = ["contains: a", "contains: 7"]
    with pytest.raises(RuntimeError, match="disk full"):
        jobs.annotate_texts_with_concepts(texts, concepts, answer, store=store, round_rows=12)
    monkeypatch.undo()
    got = jobs.annotate_texts_with_concepts(texts, concepts, answer, store=store, round_rows=12).collect()
    want = {(i, c): None if t == "hm" else int(c.removeprefix("contains: ") in t) for i, t in texts.collect() for c in concepts}
    assert {(r.row_id, r.concept): r.value for r in got} == want and len(got) == 62


def test_prompt_files(spark, tmp_path):
    prompts = spark.createDataFrame([(0, "a\nb"), (1, "c")], "row_id long, prompt string")
    tables.write_prompt_files(prompts, str(tmp_path / "files"))
    shown = {f.parent.name: f.read_text().rstrip("\x00") for f in (tmp_path / "files").glob("*/*.txt")}
    assert shown == {"prompt_idx=0": "a\nb", "prompt_idx=1": "c"}


# --- the two-topic set end to end -------------------------------------------------------

SEA = ["waves roll over the sea", "the sea is calm today", "ships cross the sea at night", "salt sea air all around"]
FIRE = ["the fire burns in the hall", "a fire keeps us warm", "smoke from the fire rises", "sparks leave the fire"]


@pytest.fixture(scope="module")
def two_topics(spark):
    rows = [(i, t + f" {i}", float(t in FIRE)) for i, t in enumerate((SEA + FIRE) * 5)]
    df = spark.createDataFrame(rows, "row_id long, text string, y double")

    def embed(batch):
        return [[float("sea" in t), float("fire" in t), 0.1 * (len(t) % 3), 0.2] for t in batch]

    vectors = jobs.embed_texts(df, embed).select("text", "embedding")
    return df.select("row_id", "text"), df.select("row_id", "y"), df.join(vectors, "text").select("row_id", "embedding")


def test_generate_and_evaluate(spark, two_topics, tmp_path):
    texts, targets, vectors = two_topics
    small = train_sae(vectors, 2, 1, n_epochs=3, seed=1)
    large = train_sae(vectors, 4, 2, prefixes=[2, 4], n_epochs=3, seed=2)
    store = stores.annotation_store(str(tmp_path / "store"), "run")
    found = generate_hypotheses(
        texts, targets, vectors, [small, large], rules.name_by_word, rules.answer_contains, store=store,
        n_selected_neurons=3, n_examples_for_interpretation=10, n_scoring_examples=10, n_candidate_interpretations=2,
    )
    assert found.columns == ["neuron_idx", "source_sae", "target_separation_score", "interpretation", "f1_fidelity_score"]
    assert found.count() == 3
    best = found.first()
    assert best.interpretation in {"contains: sea", "contains: fire"} and best.f1_fidelity_score == 1.0
    assert tuple(best.source_sae) in {(2, 1), (4, 2)}
    metrics, table = evaluate_hypotheses(["contains: fire", "contains: the"], texts, targets, rules.answer_contains, store=store)
    assert table.first().hypothesis == "contains: fire" and table.first().separation_score == 1.0
    assert metrics["auroc"] == 1.0 and metrics["Significant"][1] == 2
    unscored = generate_hypotheses(
        texts, targets, vectors, small, rules.name_by_word, n_selected_neurons=1, n_scoring_examples=0,
        selection_method="correlation",
    )
    assert unscored.columns == ["neuron_idx", "source_sae", "target_correlation", "interpretation"]
    with pytest.raises(ValueError):
        generate_hypotheses(texts, targets, vectors, small, rules.name_by_word, n_selected_neurons=3)


def test_explore(spark, two_topics):
    texts, _, vectors = two_topics
    model = train_sae(vectors, 4, 2, n_epochs=2)
    found = interpret_sae(texts, vectors, model, rules.name_by_word, n_random_neurons=2, print_examples_n=2)
    assert found.columns == ["neuron_idx", "source_sae", "interpretation", "top_example_1", "top_example_2"]
    assert found.count() == 2
    many = interpret_sae(texts, vectors, model, rules.name_by_word, neuron_indices=[0, 1], n_candidates=2, print_examples_n=0)
    assert {len(r.interpretation) for r in many.collect()} <= {1, 2}
    for bad in ({}, {"neuron_indices": [0], "n_random_neurons": 1}):
        with pytest.raises(ValueError):
            interpret_sae(texts, vectors, model, rules.name_by_word, **bad)


def test_pairs(spark, two_topics):
    texts, targets, vectors = two_topics
    rows = [(i, i, 39 - i, float(i % 8 >= 4)) for i in range(20)]
    pairs = spark.createDataFrame(rows, "pair_id long, row_a long, row_b long, y double")
    metrics, table = evaluate_pairs(["contains: fire"], texts, pairs, rules.answer_contains)
    assert table.first().separation_score is None and metrics["auroc"] == 1.0
    model = train_sae(vectors, 4, 2, n_epochs=2)
    found = generate_pair_hypotheses(
        texts, pairs, vectors, model, rules.name_by_word, rules.answer_contains, selection_method="correlation",
        n_selected_neurons=2, n_scoring_examples=8, sampling=SamplingConfig(n_examples=8),
    )
    assert found.columns == ["neuron_idx", "target_correlation", "source_sae", "interpretation", "f1_fidelity_score"]
    assert found.first().interpretation in {"contains: sea", "contains: fire"}
