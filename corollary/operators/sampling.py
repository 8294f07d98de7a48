"""Examples of features: top rows, percentile bands, random zero rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corollary.functions.text import truncate
from corollary.operators import ranking
from corollary.session import cut_lineage

#: Example rows up to which the texts are scanned against a broadcast of the examples.
BROADCAST_EXAMPLES = 1_000_000
#: Most slices the positions are cut into when rows are matched with neuron windows.
POSITION_BITS, MAX_SLICE_BITS = 52, 16


def _neuron_start(seed, neuron_idx: int) -> int:
    digest = hashlib.md5(f"draw:{seed}:neuron:{neuron_idx}".encode()).hexdigest()
    return int(digest[:13], 16)


def draw_order(seed, neuron: Column, row: Column) -> Column:
    """Random order of rows for a neuron: their hash positions, read from the neuron's start.

    A run of a random permutation is a random sample, and reading it from a place of the
    neuron's own means that one hash per row serves all neurons.
    """
    start = ranking.hash_position("draw", seed, F.lit("neuron"), neuron)
    return F.pmod(ranking.hash_position("draw", seed, row) - start, F.lit(ranking.HASH_RANGE))


def zero_rows(acts: DataFrame, rows: DataFrame, neurons: Sequence[int], n: int, seed) -> DataFrame:
    """``neuron_idx, row_id``: ``n`` random rows per neuron on which it is exactly zero.

    Rows × neurons is never formed. For each neuron only rows in a short window of
    positions, expected to hold a few more zero rows than needed, become candidates; where a window
    proves short it is made four times as wide. A neuron with so few zero rows that its window
    would hold more rows than it has zero rows gets all of those from the rows' lists of active neurons. Either way
    a neuron has about sqrt(n * rows) candidates at most.
    """
    neurons = list(dict.fromkeys(int(i) for i in neurons))
    nothing = rows.select(F.lit(0).alias("neuron_idx"), "row_id").filter(F.lit(False))
    if not neurons or n <= 0:
        return nothing
    mine = acts.filter(F.col("neuron_idx").isin(neurons)).select("neuron_idx", "row_id")
    active = {r[0]: r[1] for r in mine.groupBy("neuron_idx").count().collect()}
    total = rows.count()
    shares, wanted, dense = {}, {}, []
    for i in neurons:
        zeros = total - active.get(i, 0)
        if zeros <= 0:
            continue
        wanted[i] = min(n, zeros)
        drawn = wanted[i] + 6 * math.sqrt(wanted[i]) + 10
        if drawn * total > zeros * zeros:
            dense.append(i)
        else:
            shares[i] = drawn / zeros
    frames = []
    while shares:
        # at most n rows per neuron; written down because they are counted and then used
        found = cut_lineage(_zero_rows_in_windows(mine, rows, shares, n, seed, total))
        counts = {r[0]: r[1] for r in found.groupBy("neuron_idx").count().collect()}
        short = [i for i in shares if counts.get(i, 0) < wanted[i]]
        frames.append(found.filter(~F.col("neuron_idx").isin(short)) if short else found)
        shares = {i: min(1.0, 4 * shares[i]) for i in short}
    if dense:
        offset = draw_order(seed, F.col("neuron_idx"), F.col("row_id"))
        frames.append(
            ranking.top_n_per_group(
                all_zero_rows(mine, rows, dense).withColumn("offset", offset), ["neuron_idx"], [F.asc("offset"), F.asc("row_id")], n, salt_on="row_id"
            ).select("neuron_idx", "row_id")
        )
    return ranking.union_all(frames) if frames else nothing


def all_zero_rows(acts: DataFrame, rows: DataFrame, neurons: Sequence[int]) -> DataFrame:
    """``neuron_idx, row_id`` of all zero rows of some neurons: what is missing in each row's list of active ones.

    For neurons that are active on most rows, of which a model with K features a row has few.
    """
    active = acts.filter(F.col("neuron_idx").isin(list(neurons))).groupBy("row_id").agg(F.collect_set("neuron_idx").alias("_active"))  # K at most
    missing = F.array_except(F.lit(list(neurons)), F.coalesce("_active", F.array().cast("array<int>")))
    lists = rows.select("row_id").join(active, "row_id", "left").select("row_id", missing.alias("_missing")).filter(F.size("_missing") > 0)
    return lists.select(F.explode("_missing").alias("neuron_idx"), "row_id")


def _zero_rows_in_windows(mine, rows, shares: dict[int, float], n: int, seed, total: int) -> DataFrame:
    bits = min(MAX_SLICE_BITS, int(math.log2(1.0 / max(shares.values()))))
    shift = POSITION_BITS - bits
    windows = []
    for i, share in shares.items():
        start, length = _neuron_start(seed, i), math.ceil(share * ranking.HASH_RANGE)
        first, last = start >> shift, (start + length - 1) >> shift
        for piece in {s % (1 << bits) for s in range(first, last + 1)}:
            windows.append((i, piece, start, length))
    lookup = rows.sparkSession.createDataFrame(windows, "neuron_idx int, slice long, start long, length long")
    offset = F.pmod(F.col("position") - F.col("start"), F.lit(ranking.HASH_RANGE))
    candidates = (
        rows.select("row_id", ranking.hash_position("draw", seed, F.col("row_id")).alias("position"))
        .withColumn("slice", F.shiftright("position", shift))
        .join(F.broadcast(lookup), "slice")
        .withColumn("offset", offset)
        .filter(F.col("offset") < F.col("length"))
        .select("neuron_idx", "row_id", "offset")
    )
    taken = mine
    if 2 * sum(shares.values()) * total <= BROADCAST_EXAMPLES:
        # a few rows per neuron: find their activations without shuffling the rest
        taken = mine.join(F.broadcast(candidates.select("neuron_idx", "row_id")), ["neuron_idx", "row_id"], "left_semi")
    zeros = candidates.join(taken, ["neuron_idx", "row_id"], "left_anti")
    return ranking.top_n_per_group(
        zeros, ["neuron_idx"], [F.asc("offset"), F.asc("row_id")], n, salt_on="row_id"
    ).select("neuron_idx", "row_id")


def _with_texts(examples: DataFrame, texts: DataFrame, bound: int, max_words: int | None) -> DataFrame:
    """Attach texts to a bounded set of example rows; the text table is not shuffled."""
    side = F.broadcast(examples) if bound <= BROADCAST_EXAMPLES else examples
    text = truncate(F.col("text"), max_words) if max_words else F.col("text")
    return texts.select("row_id", "text").join(side, "row_id").select(
        "neuron_idx", "class", "row_id", "activation", text.alias("text")
    )


def _of_neurons(acts: DataFrame, neurons: Sequence[int]) -> DataFrame:
    """Activations of some neurons, written down: a sampler reads them several times, and
    each would run the model over all vectors again."""
    mine = acts.filter(F.col("neuron_idx").isin([int(i) for i in neurons]))
    return cut_lineage(mine.select("neuron_idx", "row_id", "activation"))


def _zero_examples(acts, texts, neurons, n, seed) -> DataFrame:
    return zero_rows(acts, texts, neurons, n, seed).select(
        "neuron_idx", F.lit(0).alias("class"), "row_id", F.lit(0.0).alias("activation")
    )


def sample_top_zero(
    texts: DataFrame,
    acts: DataFrame,
    neurons: Sequence[int],
    n_examples: int,
    max_words: int | None = None,
    seed=0,
) -> DataFrame:
    """``neuron_idx, class, row_id, activation, text``: half top-activating, half zero rows."""
    half = n_examples // 2
    acts = _of_neurons(acts, neurons)
    order = [F.desc("activation"), F.asc("row_id")]
    top = ranking.top_n_per_group(
        acts.filter("activation > 0"), ["neuron_idx"], order, half, salt_on="row_id"
    ).select("neuron_idx", F.lit(1).alias("class"), "row_id", "activation")
    chosen = top.unionByName(_zero_examples(acts, texts, neurons, half, seed))
    return _with_texts(chosen, texts, len(neurons) * n_examples, max_words)


def sample_percentile_bins(
    texts: DataFrame,
    acts: DataFrame,
    neurons: Sequence[int],
    n_examples: int,
    max_words: int | None = None,
    seed=0,
    high_percentile: tuple[float, float] = (90, 100),
    low_percentile: tuple[float, float] | None = None,
) -> DataFrame:
    """Random rows from a high percentile band of positive activations against a low band,
    or against zero rows when no low band is given."""
    half = n_examples // 2
    acts = _of_neurons(acts, neurons)
    mine = acts.filter("activation > 0")
    percents = {"high_from": high_percentile[0], "high_to": high_percentile[1]}
    if low_percentile is not None:
        percents |= {"low_from": low_percentile[0], "low_to": low_percentile[1]}
    # one row per neuron
    bounds = F.broadcast(ranking.grouped_percentiles(mine, "neuron_idx", "activation", percents))
    placed = mine.join(bounds, "neuron_idx").withColumn(
        "offset", draw_order(seed, F.col("neuron_idx"), F.col("row_id"))
    )
    frames = []
    for label, band in ((1, "high"), (0, "low")):
        if f"{band}_from" not in percents:
            continue
        members = placed.filter(F.col("activation").between(F.col(f"{band}_from"), F.col(f"{band}_to")))
        frames.append(
            ranking.top_n_per_group(
                members.select("neuron_idx", "row_id", "activation", "offset"),
                ["neuron_idx"], [F.asc("offset"), F.asc("row_id")], half, salt_on="row_id",
            ).select("neuron_idx", F.lit(label).alias("class"), "row_id", "activation")
        )
    if low_percentile is None:
        frames.append(_zero_examples(acts, texts, neurons, half, seed))
    return _with_texts(ranking.union_all(frames), texts, len(neurons) * n_examples, max_words)


def sample_neurons(neurons: DataFrame, n: int, seed=0) -> DataFrame:
    """``n`` random feature indices."""
    order = [ranking.hash_position("neurons", seed, F.col("neuron_idx")), F.col("neuron_idx")]
    return neurons.orderBy(*order).limit(n)


def top_texts(texts: DataFrame, acts: DataFrame, neurons: Sequence[int], n: int = 3) -> DataFrame:
    """``neuron_idx, top_example_1 .. top_example_n``, highest activation first."""
    mine = acts.filter(F.col("neuron_idx").isin([int(i) for i in neurons]) & (F.col("activation") > 0))
    order = [F.desc("activation"), F.asc("row_id")]
    top = ranking.top_n_per_group(
        mine.select("neuron_idx", "row_id", "activation"), ["neuron_idx"], order, n, salt_on="row_id"
    )
    side = F.broadcast(top) if len(neurons) * n <= BROADCAST_EXAMPLES else top
    shown = texts.select("row_id", "text").join(side, "row_id")
    columns = [
        F.max(F.when(F.col("rank") == i, F.col("text"))).alias(f"top_example_{i}") for i in range(1, n + 1)
    ]
    return shown.groupBy("neuron_idx").agg(*columns)


@dataclass
class SamplingConfig:
    """How examples are drawn. ``function`` has the signature of :func:`sample_top_zero`."""

    function: Callable[..., DataFrame] = sample_top_zero
    n_examples: int = 20
    random_seed: int = 0
    max_words_per_example: int | None = 256
    sampling_kwargs: dict[str, Any] = field(default_factory=dict)

    def draw(self, texts: DataFrame, acts: DataFrame, neurons: Sequence[int]) -> DataFrame:
        return self.function(
            texts, acts, neurons, self.n_examples, self.max_words_per_example, self.random_seed,
            **self.sampling_kwargs,
        )
