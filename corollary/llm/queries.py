"""The registered queries of this subpackage: each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corollary.llm import (
    aliases, alignment, classifier, extraction, lattice, linededup, neighbours, packing, quality, secret_scan, simhash, topk, turns,
)
from corollary.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The rules of the registered URL filter.
RULES = [
    aliases.Rule("block", "net", "/"), aliases.Rule("allow", "example.net", "/en/"), aliases.Rule("block", "example.com", "/de/"),
    aliases.Rule("allow", "org", "/fr/"),
]


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality.with_verdict(docs, labels).select(
        "doc_id", *(f"__quality.{c}" for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
        ))
    )


@query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_main_text(table(spark, sf_dir, "pages"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [
        secret_scan.spans_of_kind(F.col("__base"), name).cast("long").alias(f"n_{name}") for name in secret_scan.KINDS[:3]
    ]
    base, spans = secret_scan.joined(F.col("__base")), secret_scan.joined(F.col("__spans"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The public piece table that the registered encoder reads; any folder with such a file will do.
VOCABULARY = os.environ.get("CORPUS_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.encode(table(spark, sf_dir, "documents"), lattice.load_vocabulary(VOCABULARY))


@query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op7_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases.judge_urls(table(spark, sf_dir, "pages"), RULES)


#: Host, path and alias key of a URL, and the verdict and name of its longest rule, in SQL.
_URL_MACROS = {
    "rest": "CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) END",
    "host": "coalesce(translate(regexp_extract({0}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')",
    "path": "coalesce(regexp_extract({0}, '^[^/?#]*([^?#]*)', 1), '')",
    "query": "coalesce(regexp_extract({0}, '^[^?#]*(\\?[^#]*)?', 1), '')",
}


def _rule_sql(host: str, path: str, field: str) -> str:
    whens = " ".join(
        f"WHEN ({host} = '{r.host}' OR {host} LIKE '%.{r.host}') AND starts_with({path}, '{r.path}') THEN '{getattr(r, field)}'"
        for r in sorted(RULES, key=lambda r: -len(r.name))
    )
    return f"(CASE {whens} END)"


def _key_sql(url: str) -> str:
    rest = _URL_MACROS["rest"].format(url)
    host, path, query_ = (_URL_MACROS[k].format(rest) for k in ("host", "path", "query"))
    return f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {query_} END"


def _resolved_sql(url: str, target: str) -> str:
    rest = _URL_MACROS["rest"].format(url)
    scheme, host, path = f"split_part({url}, '://', 1)", _URL_MACROS["host"].format(rest), _URL_MACROS["path"].format(rest)
    folder = f"CASE WHEN regexp_extract({path}, '^.*/') = '' THEN '/' ELSE regexp_extract({path}, '^.*/') END"
    return f"""CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {target}
        WHEN starts_with({target}, '//') THEN {scheme} || ':' || {target}
        WHEN starts_with({target}, '/') THEN {scheme} || '://' || {host} || {target}
        ELSE {scheme} || '://' || {host} || {folder} || {target} END"""


ORACLES["op8_url_filter"] = f"""
WITH RECURSIVE tags AS (
    SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages
), sent AS (
    SELECT url, replace(CASE
        WHEN regexp_matches(tag, '(?i)\\srel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?i)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
        WHEN regexp_matches(tag, '(?i)\\shttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?i)url\\s*=\\s*["'']?([^"''\\s>]+)', 1)
        ELSE '' END, '&amp;', '&') AS target FROM tags
), edges AS (
    SELECT {_key_sql("url")} AS a, {_key_sql("(" + _resolved_sql("url", "target") + ")")} AS b FROM sent WHERE target <> ''
), arcs AS (SELECT a AS u, b AS v FROM edges WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM edges WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT u, v FROM arcs UNION SELECT r.u, s.v FROM reach r JOIN arcs s ON r.v = s.u),
spread AS (
    SELECT u, max(CASE own WHEN 'allow' THEN 2 WHEN 'block' THEN 1 END) AS found
    FROM (SELECT u, {_rule_sql("(regexp_extract(v, '^[^/?#]*'))", "(regexp_extract(v, '^[^/?#]*([^?#]*)', 1))", "verdict")} AS own FROM reach) GROUP BY u
), own AS (
    SELECT page_id, {_URL_MACROS["host"].format("(" + _URL_MACROS["rest"].format("url") + ")")} AS host,
        {_URL_MACROS["path"].format("(" + _URL_MACROS["rest"].format("url") + ")")} AS path, {_key_sql("url")} AS key FROM pages
)
SELECT page_id, host, path, {_rule_sql("host", "path", "name")} AS rule,
    coalesce({_rule_sql("host", "path", "verdict")}, CASE found WHEN 1 THEN 'block' WHEN 2 THEN 'allow' END, 'allow') AS verdict
FROM own LEFT JOIN spread ON key = u
"""


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line matches, and how many lines each had and lost."""
    kept = linededup.with_unique_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "__lines.n_lines", "__lines.n_removed", "text")


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation, and a checksum of what it leaves."""
    repaired = turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))
    return turns.digests(repaired).withColumnRenamed("conv", "conv_id")


@query
def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op12_nearest"] = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


#: The public tokenizer files of the registered alignment; any byte-level BPE and any piece BPE with byte fallback will do.
ALIGNED = (os.environ.get("CORPUS_BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json"), VOCABULARY)


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, alignment.Vocabularies.read(*ALIGNED), digest=True).withColumnRenamed("groups", "groups_sha256")
