"""Queries over sources, text functions, joins and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corollary.functions import templates, text
from corollary.functions.text import MODEL_INSTRUCTIONS, MODEL_PREFIXES
from corollary.operators import jobs, ranking, relational
from corollary.plans import rules
from corollary.plans.data import (
    CONCEPTS,
    DOCS_SQL,
    MODEL_SQL,
    documents_with_vectors,
    WORDS,
    centroid_model,
    keyword_annotations,
    neighbours,
    quality,
    scratch,
    small_activations,
    sql_annotations,
    sql_pairs,
    sql_position,
    sql_strip,
    sql_truncate,
    table,
    texts,
    vectors,
)
from corollary.plans.registry import q6, query, r6
from corollary.sources import models, stores, tables

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
SEED = 11


# --- sources and sinks ------------------------------------------------------------------


@query("s1_json_lines", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def s1_json_lines(spark, sf):
    path = scratch(spark, "json")
    documents = table(spark, sf, "documents")
    documents.write.json(path)
    back = tables.read_json_lines(spark, path, documents.schema)
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query("s2_csv", "SELECT * FROM customer")
def s2_csv(spark, sf):
    path = scratch(spark, "csv")
    customer = table(spark, sf, "customer")
    customer.write.option("header", True).csv(path)
    return tables.read_csv(spark, path, customer.schema)


@query(
    "s3_embedding_store",
    "SELECT sha256(text) AS text_key, length(text) AS n_chars, 1::BIGINT AS n_rows FROM documents GROUP BY text",
)
def s3_embedding_store(spark, sf):
    """Two overlapping runs append to one store; every text ends up in it once."""
    store = stores.embedding_store(scratch(spark, "embeddings"), "words")
    everything = texts(spark, sf)
    english = table(spark, sf, "documents").filter("lang = 'en'").select("text")
    jobs.embed_texts(english, rules.embed_words, store=store)
    jobs.embed_texts(everything, rules.embed_words, store=store)
    raw = store.read(spark)
    return raw.groupBy("text_key").agg(
        F.max(F.char_length("text")).alias("n_chars"), F.count("*").alias("n_rows")
    )


@query(
    "s4_annotation_store",
    f"SELECT concept, sha256(text) AS text_key, any_value(value) AS value, 1::BIGINT AS n_rows FROM "
    f"({sql_annotations(words=WORDS[:2])}) a JOIN documents ON doc_id = row_id GROUP BY concept, text",
)
def s4_annotation_store(spark, sf):
    store = stores.annotation_store(scratch(spark, "annotations"), "words")
    tasks = texts(spark, sf).select("text", F.explode(F.lit(CONCEPTS[:2])).alias("concept"))
    jobs.annotate(tasks.filter(F.col("concept") == CONCEPTS[0]), rules.answer_contains, store=store)
    jobs.annotate(tasks, rules.answer_contains, store=store)
    raw = store.read(spark)
    return raw.groupBy("concept", "text_key").agg(F.max("value").alias("value"), F.count("*").alias("n_rows"))


@query(
    "s5_model_table",
    f"WITH {MODEL_SQL} SELECT e.neuron_idx, {q6('any_value(b)')} AS bias, {q6('sum(w * w)')} AS enc_norm, "
    f"{q6('sum(w * c)')} AS enc_dot_center, 3 AS k, count(*) AS dim FROM enc_small e JOIN bias_small USING (neuron_idx) "
    "JOIN med USING (d) GROUP BY 1",
)
def s5_model_table(spark, sf):
    """Save a model, load it again, and describe the loaded parameters."""
    model = centroid_model(spark, sf)
    path = f"{scratch(spark, 'models')}/{models.folder_name(model.dim, model.m, model.k, model.prefixes)}"
    models.save_model(spark, model, path)
    loaded = models.load_model(spark, path)
    center = F.lit(loaded.input_bias.tolist())
    square = F.aggregate("enc", F.lit(0.0), lambda s, x: s + x * x)
    dot = F.aggregate(F.zip_with("enc", center, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return models.params_table(spark, loaded, "loaded").select(
        "neuron_idx",
        r6("bias").alias("bias"),
        r6(square).alias("enc_norm"),
        r6(dot).alias("enc_dot_center"),
        F.lit(loaded.k).alias("k"),
        F.lit(loaded.dim).cast("long").alias("dim"),
    )


def _customer_fields_sql(prefix: str = "") -> str:
    parts = ", ".join(
        f"CASE WHEN {prefix}{c} IS NOT NULL AND lower({prefix}{c}::VARCHAR) <> 'unknown' "
        f"THEN '{text.field_label(c)}: ' || {prefix}{c}::VARCHAR END"
        for c in CUSTOMER
    )
    return f"concat_ws(', ', {parts})"


N_EXAMPLES = 5
FEW_SHOT_SQL = f"""
ranked AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer),
block AS (
  SELECT '{templates.FEW_SHOT_HEADER.replace("'", "''")}' || string_agg(
    'Input: ' || {_customer_fields_sql()} || chr(10) || 'Output: ' || c_mktsegment, chr(10) || chr(10) ORDER BY r) AS b
  FROM ranked WHERE r <= {N_EXAMPLES}),
prompts AS (
  SELECT c_custkey AS row_id, b || chr(10) || chr(10) || 'Now, given a new patient:' || chr(10) || 'Input: '
    || {_customer_fields_sql()} || chr(10) || 'Output:' AS prompt
  FROM ranked, block WHERE r > {N_EXAMPLES})"""


def customer_prompts(spark, sf):
    """Few-shot prompts: the first customers are examples, all others targets."""
    customer = table(spark, sf, "customer")
    examples, targets = relational.head_tail_split(customer, N_EXAMPLES, "c_custkey")
    return relational.few_shot_prompts(
        examples, targets, CUSTOMER, "c_mktsegment", n_examples=N_EXAMPLES, row_id="c_custkey"
    )


@query("s6_write_prompts", f"WITH {FEW_SHOT_SQL} SELECT row_id AS prompt_idx, prompt FROM prompts")
def s6_write_prompts(spark, sf):
    path = scratch(spark, "prompts")
    tables.write_prompts(customer_prompts(spark, sf), path)
    return tables.read_prompts(spark, path)


# --- text functions ---------------------------------------------------------------------


@query(
    "t1_valid_lines",
    "SELECT lang, count(*) AS n_lines, sum(length(line)) AS n_chars FROM "
    "(SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) "
    f"WHERE line IS NOT NULL AND length({sql_strip('line')}) > 0 GROUP BY lang",
)
def t1_valid_lines(spark, sf):
    lines = table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return text.drop_invalid(lines, "line").groupBy("lang").agg(
        F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars")
    )


@query(
    "t2_truncate",
    f"SELECT doc_id AS row_id, {sql_truncate('text', words=50)} AS by_words, {sql_truncate('text', chars=200)} AS by_chars, "
    f"{sql_truncate('text', words=50, chars=200)} AS by_both FROM documents",
)
def t2_truncate(spark, sf):
    return texts(spark, sf).select(
        "row_id",
        text.truncate(F.col("text"), max_words=50).alias("by_words"),
        text.truncate(F.col("text"), max_chars=200).alias("by_chars"),
        text.truncate(F.col("text"), max_words=50, max_chars=200).alias("by_both"),
    )


@query(
    "t3_print_text",
    f"SELECT doc_id AS row_id, replace({sql_truncate('text', chars=128)}, chr(10), ' ') AS shown FROM documents",
)
def t3_print_text(spark, sf):
    return texts(spark, sf).select("row_id", text.for_printing(F.col("text")).alias("shown"))


@query(
    "t4_identity_key",
    "SELECT doc_id AS row_id, lang || '|||' || substring(text, 1, 100) || '...' || right(text, 100) AS key FROM documents",
)
def t4_identity_key(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), text.identity_key(F.col("lang"), F.col("text")).alias("key")
    )


@query("t5_row_to_text", f"SELECT c_custkey AS row_id, {_customer_fields_sql()} AS fields FROM customer")
def t5_row_to_text(spark, sf):
    customer = table(spark, sf, "customer")
    return customer.select(F.col("c_custkey").alias("row_id"), text.row_to_text(customer, CUSTOMER).alias("fields"))


query("t6_few_shot_prompts", f"WITH {FEW_SHOT_SQL} SELECT row_id, prompt FROM prompts")(customer_prompts)


def _template_sql(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    pieces = []
    for part in out.split("{"):
        name, brace, rest = part.partition("}")
        pieces.append(f"' || {values[name]} || '{rest}" if brace else part)
    return "".join(pieces)


@query(
    "t7_fill_template",
    f"SELECT doc_id AS row_id, md5({_template_sql(templates.ANNOTATION, hypothesis='lang', text='text')}) AS prompt_md5 "
    "FROM documents",
)
def t7_fill_template(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.md5(templates.fill(templates.ANNOTATION, hypothesis=F.col("lang"), text=F.col("text"))).alias("prompt_md5"),
    )


_NAME_FORMS = [("'- ' || {}", 0), ("'- \"' || {} || '\"'", 1), ("'  \"- ' || {} || '\"'", 2), ("'\" -' || {} || '\"\"'", 3)]


@query(
    "t8_clean_name",
    "WITH raw AS ("
    + " UNION ALL ".join(f"SELECT p_partkey, {i} AS form, {f.format('p_name')} AS r FROM part" for f, i in _NAME_FORMS)
    + f"), a AS (SELECT *, {sql_strip('r')} AS n FROM raw), "
    "b AS (SELECT *, CASE WHEN starts_with(n, '- ') THEN substring(n, 3) ELSE n END AS n1 FROM a), "
    "c AS (SELECT *, CASE WHEN starts_with(n1, '\"-') THEN substring(n1, 3) ELSE n1 END AS n2 FROM b), "
    "d AS (SELECT *, CASE WHEN starts_with(n2, '\" -') THEN substring(n2, 4) ELSE n2 END AS n3 FROM c) "
    "SELECT p_partkey, form, trim(n3, '\"') AS name FROM d",
)
def t8_clean_name(spark, sf):
    forms = F.array(
        *[F.struct(F.lit(i).alias("form"), F.expr(f.format("p_name")).alias("r")) for f, i in _NAME_FORMS]
    )
    return table(spark, sf, "part").select("p_partkey", F.inline(forms)).select(
        "p_partkey", "form", text.clean_name(F.col("r")).alias("name")
    )


@query(
    "t9_yes_no",
    "SELECT doc_id AS row_id, CASE WHEN contains(lower(text), 'yes') THEN 1 WHEN contains(lower(text), 'no') THEN 0 END "
    "AS value FROM documents",
)
def t9_yes_no(spark, sf):
    return texts(spark, sf).select("row_id", text.parse_yes_no(F.col("text")).alias("value"))


_GRADES = ["Yes, ", " related: ", "NO ", ""]


@query(
    "t10_graded_answer",
    "SELECT conv_id, "
    + q6(
        f"avg(CASE WHEN starts_with(a, 'yes') THEN 1.0 WHEN starts_with(a, 'related') THEN 0.5 "
        "WHEN starts_with(a, 'no') THEN 0.0 END)"
    )
    + f" AS similarity FROM (SELECT conv_id, {sql_strip('lower(g || text)')} AS a FROM conversations, "
    f"(SELECT unnest([{', '.join(repr(g) for g in _GRADES)}]) AS g)) GROUP BY conv_id",
)
def t10_graded_answer(spark, sf):
    answers = table(spark, sf, "conversations").select(
        "conv_id", F.explode(F.array(*[F.concat(F.lit(g), "text") for g in _GRADES])).alias("answer")
    )
    return answers.groupBy("conv_id").agg(r6(F.avg(text.parse_graded(F.col("answer")))).alias("similarity"))


@query(
    "t11_model_input",
    f"SELECT doc_id AS row_id, md5('{MODEL_PREFIXES['nomic-ai']}' || text) AS input_md5, md5(text) AS raw_md5 FROM documents",
)
def t11_model_input(spark, sf):
    return texts(spark, sf).select(
        "row_id",
        F.md5(text.model_input(F.col("text"), "nomic-ai/modernbert-embed-base")).alias("input_md5"),
        F.md5(text.model_input(F.col("text"), "plain")).alias("raw_md5"),
    )


@query(
    "t11_instruction_input",
    f"SELECT doc_id AS row_id, '{MODEL_INSTRUCTIONS['instructor']}' AS instruction, md5(text) AS text_md5, 2 AS parts FROM documents",
)
def t11_instruction_input(spark, sf):
    """The pair that an instruction model gets."""
    given = text.model_input(F.col("text"), "hkunlp/instructor-xl")
    return texts(spark, sf).select("row_id", given.alias("given")).select(
        "row_id", F.col("given")[0].alias("instruction"), F.md5(F.col("given")[1]).alias("text_md5"), F.size("given").alias("parts")
    )


STATUS = {"F": 0, "P": 0, "O": 1}


@query(
    "t12_label_mapping",
    "SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 0 WHEN 'O' THEN 1 END AS y FROM orders",
)
def t12_label_mapping(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), text.map_labels(F.col("o_orderstatus"), STATUS).alias("y")
    )


@query(
    "t13_task_type",
    "SELECT 'quality' AS target, bool_and(quality IN (0, 1)) AS classification FROM labels "
    "UNION ALL SELECT 'label', bool_and(label IN (0, 1)) FROM embeddings",
)
def t13_task_type(spark, sf):
    named = [("quality", quality(spark, sf)), ("label", vectors(spark, sf))]
    return ranking.union_all(
        [relational.is_binary(df).select(F.lit(name).alias("target"), "classification") for name, df in named]
    )


# --- joins, set operations, splits, samples ---------------------------------------------


@query(
    "j1_uncached_texts",
    "SELECT DISTINCT sha256(text) AS text_key, length(text) AS n_chars FROM documents "
    "WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')",
)
def j1_uncached_texts(spark, sf):
    known = table(spark, sf, "documents").filter("lang = 'en'").select(text.text_key(F.col("text")).alias("text_key"))
    found = relational.uncached_texts(texts(spark, sf), known)
    return found.select("text_key", F.char_length("text").alias("n_chars"))


@query(
    "j2_cached_tasks",
    f"""WITH tasks AS (SELECT DISTINCT concept, sha256(text) AS text_key FROM ({sql_annotations()}) a
          JOIN documents ON doc_id = row_id),
        store AS (SELECT DISTINCT concept, sha256(text) AS text_key, value FROM ({sql_annotations(words=WORDS[:3])}) a
          JOIN documents ON doc_id = row_id WHERE lang = 'en')
        SELECT concept, text_key, value, value IS NOT NULL AS cached FROM tasks LEFT JOIN store USING (concept, text_key)""",
)
def j2_cached_tasks(spark, sf):
    keys = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), "lang", text.text_key(F.col("text")).alias("text_key")
    )
    cells = keyword_annotations(spark, sf).join(keys, "row_id")
    store = cells.filter((F.col("lang") == "en") & F.col("concept").isin(CONCEPTS[:3]))
    store = store.select("concept", "text_key", "value").distinct()
    hits, todo = relational.split_cached_tasks(cells, store)
    return hits.withColumn("cached", F.lit(True)).unionByName(
        todo.select("concept", "text_key", F.lit(None).cast("int").alias("value"), F.lit(False).alias("cached"))
    )


@query(
    "j3_lookup_vectors",
    f"""WITH known AS (SELECT text, arg_min(embedding, doc_id) AS embedding FROM {DOCS_SQL} GROUP BY text)
        SELECT doc_id AS row_id, {q6('embedding[1]')} AS first, {q6('embedding[64]')} AS last, len(embedding)::INTEGER AS dim
        FROM documents JOIN known USING (text)""",
)
def j3_lookup_vectors(spark, sf):
    store = documents_with_vectors(spark, sf).groupBy(text.text_key(F.col("text")).alias("text_key")).agg(
        F.min_by("embedding", "row_id").alias("embedding")
    )
    found = relational.lookup_vectors(texts(spark, sf), store)
    return found.select(
        "row_id",
        r6(F.col("embedding")[0]).alias("first"),
        r6(F.element_at("embedding", 64)).alias("last"),
        F.size("embedding").alias("dim"),
    )


@query(
    "j4_text_by_concept",
    f"SELECT doc_id AS row_id, concept, md5(text || concept) AS pair_md5 FROM documents, (SELECT unnest({CONCEPTS!r}) AS concept)",
)
def j4_text_by_concept(spark, sf):
    pairs = relational.with_every_concept(texts(spark, sf), CONCEPTS)
    return pairs.select("row_id", "concept", F.md5(F.concat("text", "concept")).alias("pair_md5"))


_TOP_EXAMPLES_SQL = """
examples AS (SELECT neuron_idx, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY neuron_idx ORDER BY activation DESC, row_id) AS r FROM act) WHERE r <= 8),
names AS (SELECT DISTINCT label AS neuron_idx, 'contains: ' || lang AS interpretation FROM embeddings
  JOIN documents ON doc_id = vec_id)"""


@query(
    "j5_example_tasks",
    f"WITH {MODEL_SQL}, {_TOP_EXAMPLES_SQL} SELECT neuron_idx, row_id, interpretation FROM examples JOIN names USING (neuron_idx)",
)
def j5_example_tasks(spark, sf):
    top = ranking.top_n_per_group(
        small_activations(spark, sf), ["neuron_idx"], [F.desc("activation"), F.asc("row_id")], 8, salt_on="row_id"
    )
    labelled = vectors(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang"), "row_id")
    names = labelled.select(
        F.col("y").cast("int").alias("neuron_idx"), F.concat(F.lit("contains: "), "lang").alias("interpretation")
    )
    return relational.example_tasks(top, names).select("neuron_idx", "row_id", "interpretation")


@query(
    "j6_annotation_vectors",
    f"WITH a AS ({sql_annotations()}) SELECT row_id, "
    + ", ".join(f"max(value) FILTER (WHERE concept = '{c}') AS c{i}" for i, c in enumerate(CONCEPTS))
    + " FROM a GROUP BY row_id",
)
def j6_annotation_vectors(spark, sf):
    rows = texts(spark, sf).select("row_id", text.text_key(F.col("text")).alias("text_key"))
    answers = keyword_annotations(spark, sf).join(rows, "row_id").select("text_key", "concept", "value").distinct()
    return relational.annotation_vectors(rows, answers, CONCEPTS).drop("text_key")


PAIRS_SQL = f"""
pairs AS ({sql_pairs('embeddings', 'vec_id', 'label')}),
diff AS (
  SELECT * FROM (
    SELECT pair_id, neuron_idx, coalesce(za, 0) - coalesce(zb, 0) AS activation FROM
      (SELECT pair_id, neuron_idx, activation AS za FROM pairs JOIN act ON row_id = row_a)
      FULL JOIN (SELECT pair_id, neuron_idx, activation AS zb FROM pairs JOIN act ON row_id = row_b)
      USING (pair_id, neuron_idx))
  WHERE activation <> 0)"""


def vector_pairs(spark, sf):
    return neighbours(table(spark, sf, "embeddings"), "vec_id", F.col("label"))


def document_pairs(spark, sf):
    return neighbours(table(spark, sf, "documents"), "doc_id", F.col("n_chars"))


DOCUMENT_PAIRS_SQL = f"pairs AS ({sql_pairs('documents', 'doc_id', 'n_chars')})"


@query(
    "j7_pair_activations",
    f"WITH {MODEL_SQL}, {PAIRS_SQL} SELECT pair_id, neuron_idx, {q6('activation')} AS activation FROM diff",
)
def j7_pair_activations(spark, sf):
    diff = relational.pair_activation_difference(vector_pairs(spark, sf), small_activations(spark, sf))
    return diff.select("pair_id", "neuron_idx", r6("activation").alias("activation"))


@query(
    "j8_pair_annotations",
    f"WITH ann AS ({sql_annotations()}), {DOCUMENT_PAIRS_SQL} SELECT pair_id, a.concept, (a.value - b.value)::INTEGER AS value "
    "FROM pairs JOIN ann a ON a.row_id = row_a JOIN ann b ON b.row_id = row_b AND a.concept = b.concept",
)
def j8_pair_annotations(spark, sf):
    return relational.pair_annotation_difference(document_pairs(spark, sf), keyword_annotations(spark, sf))


@query("j9_distinct_texts", "SELECT DISTINCT text FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) ORDER BY text")
def j9_distinct_texts(spark, sf):
    return relational.distinct_texts((table(spark, sf, "documents"), "text"), (table(spark, sf, "benchmark"), "text"))


@query("j10_all_texts", "SELECT md5(text) AS text_md5, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) GROUP BY text")
def j10_all_texts(spark, sf):
    both = relational.all_texts(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return both.groupBy("text").count().select(F.md5("text").alias("text_md5"), F.col("count").alias("n"))


def _hash_rank(purpose: str) -> str:
    return f"row_number() OVER (ORDER BY {sql_position(f"'{purpose}:{SEED}:' || doc_id")}, doc_id)"


@query(
    "j11_train_validation",
    f"SELECT doc_id AS row_id, {_hash_rank('split')} <= ceil((SELECT count(*) FROM documents) * 0.1) AS validation FROM documents",
)
def j11_train_validation(spark, sf):
    train, held = relational.train_validation_split(texts(spark, sf), 0.1, SEED)
    return held.select("row_id", F.lit(True).alias("validation")).unionByName(
        train.select("row_id", F.lit(False).alias("validation"))
    )


@query("j12_sample", f"SELECT doc_id AS row_id FROM documents QUALIFY {_hash_rank('sample')} <= 150")
def j12_sample(spark, sf):
    return ranking.hash_sample(texts(spark, sf), 150, SEED).select("row_id")


@query(
    "j13_head_tail",
    f"SELECT c_custkey AS row_id, row_number() OVER (ORDER BY c_custkey) <= {N_EXAMPLES} AS example FROM customer",
)
def j13_head_tail(spark, sf):
    head, tail = relational.head_tail_split(table(spark, sf, "customer"), N_EXAMPLES, "c_custkey")
    return head.select(F.col("c_custkey").alias("row_id"), F.lit(True).alias("example")).unionByName(
        tail.select(F.col("c_custkey").alias("row_id"), F.lit(False).alias("example"))
    )
