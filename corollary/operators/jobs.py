"""Batch jobs around a user's model: embed, name, annotate, compare.

The model is a callable over a list of strings. The jobs drop invalid input, do each
distinct piece of work once, skip what a store already holds, retry unclear answers and
append the new results. Answers are written down before they are used, because a model
need not answer the same way twice.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corollary.functions import templates, text
from corollary.operators import ranking, relational
from corollary.operators.sampling import SamplingConfig
from corollary.session import cut_lineage, folder_exists, remove_folder
from corollary.sources.stores import Store

EmbedFn = Callable[[list[str] | list[list[str]]], Sequence[Sequence[float]]]
AnswerFn = Callable[[list[str]], Sequence[str]]

#: Tries for a failing call or an unclear answer, and seconds before the second call
#: (doubled before each further one).
MAX_TRIES, PAUSE = 3, 1.0
EMBED_BATCH = 128
ANSWER_BATCH = 64
#: Model calls one task makes at most, unless the caller sets the number of partitions.
CALLS_PER_TASK = 100_000
#: Texts or tasks of a round, after which a store is written to, and files of its work table.
ROUND_ROWS, ROUND_FILES = 500_000, 8


@dataclass
class InterpretConfig:
    """How features are named."""

    sampling: SamplingConfig = field(default_factory=SamplingConfig)
    n_candidates: int = 1
    template: str = templates.NAMING
    task_specific_instructions: str | None = None
    batch_size: int = ANSWER_BATCH


def _chunks(items: list, size: int) -> Iterator[list]:
    for at in range(0, len(items), size):
        yield items[at : at + size]


def _spread(tasks: DataFrame, partitions: int | None, keys: Sequence[str], n_calls: int = 0) -> DataFrame:
    """Spread model calls over the cluster by their keys.

    The number of partitions is explicit: sizing them by bytes, as is usual after a
    shuffle, would put many slow calls into one task.
    """
    cores = tasks.sparkSession.sparkContext.defaultParallelism
    return tasks.repartition(partitions or max(cores, -(-n_calls // CALLS_PER_TASK)), *keys)


def _call(fn: Callable, batch: list[str], tries: int = MAX_TRIES) -> list:
    """Call the model, again on failure; the last failure is raised."""
    for attempt in range(tries):
        try:
            answers = list(fn(batch))
            if len(answers) != len(batch):
                raise ValueError(f"model returned {len(answers)} answers for {len(batch)} inputs")
            return answers
        except Exception:
            if attempt == tries - 1:
                raise
            time.sleep(PAUSE * 2**attempt)
    return []


def _call_each(fn: Callable, batch: list[str]) -> list:
    """Answers of one batch; if the batch fails, one by one with None for failures."""
    try:
        return _call(fn, batch, 1)
    except Exception:
        answers = []
        for item in batch:
            try:
                answers += _call(fn, [item], 1)
            except Exception:
                answers.append(None)
        return answers


def _read_yes_no(answer: str | None) -> int | None:
    lowered = (answer or "").lower()
    return 1 if "yes" in lowered else 0 if "no" in lowered else None


@dataclass(frozen=True)
class _Work:
    """Open tasks of a job, written once in folders by round. A round is done when the store lists its commit."""

    store: Store
    job: str
    rounds: int

    @property
    def folder(self) -> str:
        return f"{self.store.root}/work/{self.job}-of-{self.rounds}"

    def commit(self, i: int) -> str:
        return f"{self.job}-of-{self.rounds}-{i}"

    def write(self, tasks: DataFrame) -> None:
        place = F.pmod(F.xxhash64("text_key"), F.lit(self.rounds)).cast("int")
        part = F.pmod(F.xxhash64("text_key", F.lit(1)), F.lit(ROUND_FILES))
        tasks.withColumn("round", place).repartition("round", part).write.mode("overwrite").partitionBy("round").parquet(self.folder)

    def read(self, spark: SparkSession, i: int, schema) -> DataFrame | None:
        path = f"{self.folder}/round={i}"
        return spark.read.schema(schema).parquet(path) if folder_exists(spark, path) else None


def _in_rounds(
    store: Store, marks: DataFrame, tasks: Callable[[], DataFrame], finish: Callable[[DataFrame], DataFrame], round_rows: int,
    per_mark: int = 1, name: str = "",
) -> None:
    """Do the tasks that a store lacks, in rounds of about ``round_rows``, each a commit of the store.

    ``marks`` and ``name`` identify the job. Its tasks are written down under that, so a job that failed goes on with its first open
    round, without reading its input again; what is open even then (an unclear answer, a file that was lost) is done after it.
    """
    spark = marks.sparkSession
    count, mark = marks.agg(F.count("*"), F.bit_xor(F.xxhash64(*marks.columns))).first()
    rounds = max(1, -(-count * per_mark // round_rows))
    base = f"{name}{count}-{(mark or 0) & (1 << 64) - 1:016x}"
    snapshot, published = store.snapshot(spark), store.commits(spark)
    attempt = 0
    while True:
        work = _Work(store, f"{base}-{attempt}", rounds)
        resumed = folder_exists(spark, f"{work.folder}/_SUCCESS")
        if resumed or not any(c.startswith(f"{work.job}-of-") for c in published):
            break
        attempt += 1  # the same job has ended before; what is open now are other tasks
    todo = tasks()
    if not resumed:
        work.write(todo)
    for i in range(rounds):
        part = None if work.commit(i) in published else work.read(spark, i, todo.schema)
        if part is not None:
            store.append(finish(part), commit=work.commit(i), snapshot=snapshot)
            snapshot = [*snapshot, *(f for f in store.snapshot(spark) if f.commit == work.commit(i))]
    remove_folder(spark, work.folder)
    if resumed:
        _in_rounds(store, marks, tasks, finish, round_rows, per_mark, name)


def embed_texts(
    texts: DataFrame,
    embed_fn: EmbedFn,
    *,
    store: Store | None = None,
    model: str = "",
    batch_size: int = EMBED_BATCH,
    partitions: int | None = None,
    round_rows: int = ROUND_ROWS,
) -> DataFrame:
    """``text_key, text, embedding`` of every distinct valid text.

    ``partitions`` bounds how many model calls run at once, for a rate-limited model. With a
    store, every ``round_rows`` texts are stored as soon as they are done, and a run that failed
    goes on with its first open round; a text that is in no readable file of the store is asked
    again, and one that is still missing at the end is an error.
    """
    spark = texts.sparkSession

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = []
            inputs = [x if isinstance(x, str) else list(x) for x in frame["_input"]]  # text, or instruction and text
            for batch in _chunks(inputs, batch_size):
                vectors += [[float(x) for x in v] for v in _call(embed_fn, batch)]
            yield frame[["text_key", "text"]].assign(embedding=vectors)

    def embedded(part: DataFrame, n_calls: int) -> DataFrame:
        spread = _spread(part, partitions, ["text_key"], n_calls)
        return spread.mapInPandas(embed, "text_key string, text string, embedding array<float>")

    def todo(known: DataFrame) -> DataFrame:
        return relational.uncached_texts(texts, known).withColumn("_input", text.model_input(F.col("text"), model))

    if store is None:
        return cut_lineage(embedded(todo(spark.createDataFrame([], "text_key string")), texts.count()))
    wanted = cut_lineage(text.drop_invalid(texts).select(text.text_key(F.col("text")).alias("text_key")).distinct())
    _in_rounds(store, wanted, lambda: todo(store.read(spark, wanted)), lambda part: embedded(part, round_rows), round_rows)
    found = store.read(spark, wanted)
    missing = wanted.join(found.select("text_key"), "text_key", "left_anti").count()
    if missing:
        raise RuntimeError(f"{missing} embeddings can't be read back from {store.path}")
    return found


def _shown(max_words: int | None) -> Column:
    """What the model sees of a text. Cut before any shuffle; the key is of the whole text."""
    return (text.truncate(F.col("text"), max_words) if max_words else F.col("text")).alias("text")


def _answer_tasks(tasks: DataFrame, answer_fn: AnswerFn, template: str, batch_size: int) -> DataFrame:
    """``concept, text_key, value`` for tasks ``concept, text_key, text``; NULL = no clear answer."""
    prompts = tasks.select(
        "concept",
        "text_key",
        templates.fill(template, hypothesis=F.col("concept"), text=F.col("text")).alias("prompt"),
    )

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values: list[int | None] = [None] * len(frame)
            prompts = frame["prompt"].tolist()
            for rows in _chunks(list(range(len(frame))), batch_size):
                open_rows = rows
                for _ in range(MAX_TRIES):
                    for row, reply in zip(open_rows, _call_each(answer_fn, [prompts[r] for r in open_rows])):
                        values[row] = _read_yes_no(reply)
                    open_rows = [r for r in open_rows if values[r] is None]
                    if not open_rows:
                        break
            yield frame[["concept", "text_key"]].assign(value=pd.array(values, dtype="Int32"))

    return prompts.mapInPandas(answer, "concept string, text_key string, value int")


def annotate(
    tasks: DataFrame,
    answer_fn: AnswerFn,
    *,
    store: Store | None = None,
    max_words: int | None = None,
    template: str = templates.ANNOTATION,
    batch_size: int = ANSWER_BATCH,
    partitions: int | None = None,
    round_rows: int = ROUND_ROWS,
) -> DataFrame:
    """``concept, text_key, value`` for distinct tasks ``(text, concept)``.

    Tasks the store holds are answered from it. A failed task has a NULL value and is
    not stored, so a later run asks again.
    """
    spark = tasks.sparkSession
    keyed = (
        tasks.select("concept", _shown(max_words), text.text_key(F.col("text")).alias("text_key"))
        .groupBy("concept", "text_key")
        .agg(F.first("text").alias("text"))
    )

    def answered(part: DataFrame) -> DataFrame:
        spread = _spread(part, partitions, ["concept", "text_key"])
        return cut_lineage(_answer_tasks(spread, answer_fn, template, batch_size))

    if store is None:
        return answered(keyed)
    wanted = cut_lineage(keyed.select("concept", "text_key"))
    _in_rounds(
        store, wanted, lambda: keyed.join(store.read(spark, wanted), ["concept", "text_key"], "left_anti"),
        lambda part: answered(part).filter("value IS NOT NULL"), round_rows,
    )
    return wanted.join(store.read(spark, wanted), ["concept", "text_key"], "left")


def annotate_texts_with_concepts(
    texts: DataFrame, concepts: DataFrame | Sequence[str], answer_fn: AnswerFn, **options
) -> DataFrame:
    """``row_id, concept, value`` for every text with every concept.

    ``options`` are those of :func:`annotate`.
    """
    rows, answers = _answer_texts(texts, concepts, answer_fn, **options)
    return relational.lookup_join(rows, answers, "text_key", "inner").select("row_id", "concept", "value")


def annotation_columns(texts: DataFrame, concepts: Sequence[str], answer_fn: AnswerFn, **options) -> DataFrame:
    """The same with one column ``c0, c1, ..`` per concept.

    Answers are made wide per distinct text, so one short record per text is shuffled
    instead of one per text and concept.
    """
    rows, answers = _answer_texts(texts, concepts, answer_fn, **options)
    return relational.annotation_vectors(rows, answers, concepts).drop("text_key")


def _answer_texts(
    texts: DataFrame,
    concepts: DataFrame | Sequence[str],
    answer_fn: AnswerFn,
    *,
    store: Store | None = None,
    max_words: int | None = None,
    template: str = templates.ANNOTATION,
    batch_size: int = ANSWER_BATCH,
    partitions: int | None = None,
    round_rows: int = ROUND_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """``row_id, text_key`` and the answers ``text_key, concept, value``.

    A text, cut to what the model sees, is shuffled once, when repeats are removed; the
    concepts a store already answers for it come to it as a short list, and only the open
    ones are asked. The row keys are written down, so the texts are not read again to
    bring the answers back to their rows.
    """
    key = text.text_key(F.col("text")).alias("text_key")
    rows = cut_lineage(texts.select("row_id", key))
    distinct = texts.select(_shown(max_words), key).groupBy("text_key").agg(F.first("text").alias("text"))
    n_concepts = concepts.count() if isinstance(concepts, DataFrame) else len(concepts)

    def answered(part: DataFrame) -> DataFrame:
        """Answers to all concepts of a text that aren't in its list of answered ones."""
        spread = _spread(part, partitions, ["text_key"], rows.count() * n_concepts)
        pairs = relational.with_every_concept(spread, concepts)
        if "_done" in part.columns:
            known = F.coalesce(F.array_contains("_done", F.col("concept")), F.lit(False))
            pairs = pairs.filter(~known).drop("_done")
        return cut_lineage(_answer_tasks(pairs, answer_fn, template, batch_size))

    if store is None:
        return rows, answered(distinct)
    spark, wanted = texts.sparkSession, cut_lineage(rows.select("text_key").distinct())
    unclear: list[DataFrame] = []

    def known() -> DataFrame:
        return _only_concepts(store.read(spark, wanted), concepts)

    def tasks() -> DataFrame:
        unclear.clear()
        done = known().groupBy("text_key").agg(F.collect_set("concept").alias("_done"))
        return distinct.join(done, "text_key", "left").filter(F.coalesce(F.size("_done"), F.lit(0)) < _distinct_concepts(concepts))

    def finish(part: DataFrame) -> DataFrame:
        fresh = answered(part)
        unclear.append(fresh.filter("value IS NULL"))
        return fresh.filter("value IS NOT NULL")

    _in_rounds(store, wanted, tasks, finish, round_rows, max(1, n_concepts), _concepts_name(concepts))
    return rows, ranking.union_all([known().select("concept", "text_key", "value"), *unclear])


def _distinct_concepts(concepts: DataFrame | Sequence[str]) -> int:
    return concepts.select("concept").distinct().count() if isinstance(concepts, DataFrame) else len(set(concepts))


def _concepts_name(concepts: DataFrame | Sequence[str]) -> str:
    """A name for a list of concepts, in which their order doesn't count."""
    if isinstance(concepts, DataFrame):
        mark = concepts.select("concept").distinct().agg(F.bit_xor(F.xxhash64("concept"))).first()[0] or 0
        return f"{mark & (1 << 64) - 1:016x}-"
    return hashlib.md5("\0".join(sorted(set(concepts))).encode()).hexdigest()[:16] + "-"


def _only_concepts(answers: DataFrame, concepts: DataFrame | Sequence[str]) -> DataFrame:
    if isinstance(concepts, DataFrame):
        return answers.join(concepts.select("concept").distinct(), "concept", "left_semi")
    return answers.filter(F.col("concept").isin(list(concepts)))


def naming_prompts(examples: DataFrame, template: str, instructions: str | None) -> DataFrame:
    """``neuron_idx, prompt`` from sampled examples; texts one per line, best first.

    Features without any positive row among the examples get no prompt.

    Custom samplers may use classes other than 0 and 1: class ``c`` fills the
    placeholder ``class_<c>_texts``.
    """
    names = {"positive_texts": 1, "negative_texts": 0}
    for name in templates.placeholders(template):
        if name.startswith("class_") and name.endswith("_texts"):
            names[name] = int(name[len("class_") : -len("_texts")])
    blocks = []
    for name, label in names.items():
        # bounded by n_examples per neuron
        rows = F.collect_list(
            F.when(F.col("class") == label, F.struct((-F.col("activation")).alias("a"), "row_id", "text"))
        )
        blocks.append(F.array_join(F.transform(F.array_sort(rows), lambda s: s["text"]), "\n").alias(name))
    grouped = examples.groupBy("neuron_idx").agg(*blocks, F.max("activation").alias("_top")).filter("_top > 0")
    filled = templates.fill(
        template,
        task_specific_instructions=F.lit(instructions or templates.TASK_INSTRUCTIONS),
        **{name: F.col(name) for name in names},
    )
    return grouped.select("neuron_idx", filled.alias("prompt"))


def interpret_neurons(
    texts: DataFrame,
    acts: DataFrame,
    neurons: Sequence[int],
    complete_fn: AnswerFn,
    config: InterpretConfig | None = None,
) -> DataFrame:
    """``neuron_idx, candidate_idx, interpretation``.

    A candidate whose call failed is dropped; a feature without any positive row, or
    without any candidate left, has one row with a NULL name.
    """
    config = config or InterpretConfig()
    spark = acts.sparkSession
    examples = config.sampling.draw(texts, acts, neurons)
    tasks = naming_prompts(examples, config.template, config.task_specific_instructions)
    tasks = tasks.withColumn(
        "candidate_idx", F.explode(F.sequence(F.lit(0), F.lit(config.n_candidates - 1)))
    )

    def complete(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = []
            for batch in _chunks(frame["prompt"].tolist(), config.batch_size):
                replies += _call_each(complete_fn, batch)
            yield frame[["neuron_idx", "candidate_idx"]].assign(reply=replies)

    tasks = _spread(tasks, None, ["neuron_idx", "candidate_idx"])
    replies = cut_lineage(tasks.mapInPandas(complete, "neuron_idx int, candidate_idx int, reply string"))
    named = replies.filter("reply IS NOT NULL").select(
        "neuron_idx", "candidate_idx", text.clean_name(F.col("reply")).alias("interpretation")
    )
    asked = spark.createDataFrame([(int(i),) for i in neurons], "neuron_idx int").distinct()
    return asked.join(named, "neuron_idx", "left").select(
        "neuron_idx", F.coalesce("candidate_idx", F.lit(0)).alias("candidate_idx"), "interpretation"
    )


def surface_similarity(
    pairs: DataFrame,
    answer_fn: AnswerFn,
    *,
    n_samples: int = 5,
    template: str = templates.SIMILARITY,
    batch_size: int = ANSWER_BATCH,
) -> DataFrame:
    """``text_a, text_b, similarity``: mean graded answer over the valid samples, else NULL."""
    tasks = pairs.select("text_a", "text_b").distinct().select(
        "text_a",
        "text_b",
        templates.fill(template, text_a=F.col("text_a"), text_b=F.col("text_b")).alias("prompt"),
        F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("sample"),
    )

    def grade(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = []
            for batch in _chunks(frame["prompt"].tolist(), batch_size):
                replies += _call_each(answer_fn, batch)
            yield frame[["text_a", "text_b"]].assign(reply=replies)

    tasks = _spread(tasks, None, ["text_a", "text_b", "sample"])
    replies = cut_lineage(tasks.mapInPandas(grade, "text_a string, text_b string, reply string"))
    return replies.groupBy("text_a", "text_b").agg(
        F.avg(text.parse_graded(F.col("reply"))).alias("similarity")
    )
