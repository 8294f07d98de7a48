"""Physical plans: what is read, what is shuffled, what runs in Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corollary.functions import text
from corollary.operators import features, ranking, relational, sampling, selection
from corollary.plans import data, queries_text
from corollary.sources import stores

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def shuffles(df) -> int:
    return len(re.findall(r"^\(\d+\) Exchange", plan(df), re.MULTILINE))


@pytest.fixture(scope="module")
def acts(spark):
    return data.small_activations(spark, SF, carry=("y",))


def test_inference_reads_three_columns_and_shuffles_nothing(spark, acts):
    assert shuffles(acts) == 0
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in plan(acts)
    both = features.many_activations(data.vectors(spark, SF), [data.centroid_model(spark, SF)] * 2)
    assert plan(both).count("Scan parquet") == 2  # once in the tree, once in the details: a single scan


def test_text_functions_stay_in_the_jvm_without_shuffles(spark):
    for name in ("t2_truncate", "t4_identity_key", "t5_row_to_text", "t7_fill_template", "j4_text_by_concept"):
        df = entry.queries()[name](spark, SF)
        assert shuffles(df) == 0, name
        assert "EvalPython" not in plan(df) and "MapInArrow" not in plan(df), name


def test_filters_and_columns_reach_the_scan(spark):
    english = data.table(spark, SF, "documents").filter("lang = 'en'").select("doc_id")
    assert "EqualTo(lang,en)" in plan(english)
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan(english)


def test_few_shot_targets_are_not_shuffled(spark):
    text_plan = plan(queries_text.customer_prompts(spark, SF))
    main = text_plan.split("===== Subqueries =====")[0]
    assert not re.search(r"^\(\d+\) Exchange", main, re.MULTILINE)


def test_selection_with_a_carried_target_shuffles_sums_only(spark, acts):
    scores = selection.correlation_scores(acts, data.vectors(spark, SF))
    main = plan(scores).split("===== Subqueries =====")[0]
    assert len(re.findall(r"^\(\d+\) Exchange", main, re.MULTILINE)) == 1
    assert "Join" not in main and main.index("partial_sum") < main.index("Exchange\n")


def test_top_rows_are_cut_before_the_shuffle(acts):
    top = ranking.top_n_per_group(acts, ["neuron_idx"], [F.desc("activation"), F.asc("row_id")], 10)
    tree = plan(top).split("\n\n")[0]
    assert tree.count("WindowGroupLimit") == 2
    assert tree.rindex("WindowGroupLimit") > tree.index("Exchange")


def test_texts_meet_examples_without_a_shuffle(spark, acts):
    texts = data.texts(spark, SF)
    top = ranking.top_n_per_group(acts, ["neuron_idx"], [F.desc("activation")], 2)
    chosen = top.select("neuron_idx", F.lit(1).alias("class"), "row_id", "activation")
    joined = plan(sampling._with_texts(chosen, texts, 20, None))
    assert "BroadcastHashJoin" in joined and "SortMergeJoin" not in joined


def test_store_reads_its_own_files(spark, tmp_path):
    for name in ("a", "b"):
        store = stores.annotation_store(str(tmp_path / "store"), name)
        store.append(spark.createDataFrame([("c", name, 1)], store.schema))
    read = store.read(spark)
    assert all("/cache_name=b/" in f for f in read.inputFiles()) and "Exchange" not in plan(read)
    assert [r.text_key for r in read.collect()] == ["b"]


def test_no_cartesian_products(spark):
    for name in ("j1_uncached_texts", "j6_annotation_vectors", "j7_pair_activations", "n1_correlation", "n2_separation",
                 "x2_percentile_bands", "e1_separation", "e6_auroc", "f1_recall_precision", "t6_few_shot_prompts"):
        shown = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in shown and "NestedLoop" not in shown, name


def test_pairs_and_prompts_use_equal_keys(spark):
    tasks = relational.with_every_concept(data.texts(spark, SF), data.CONCEPTS)
    assert "Generate" in plan(tasks) and "Join" not in plan(tasks)
    shown = data.texts(spark, SF).select(text.for_printing(F.col("text")))
    assert "ReadSchema: struct<text:string>" in plan(shown)
