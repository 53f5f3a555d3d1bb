"""Queries over the tables as a collection: scans, prompts, scores and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from augsearch.functions import text
from augsearch.operators import encoders, prompts, reports
from augsearch.plans.registry import register
from augsearch.sources import collection, logs

#: table -> (key, columns)
TABLES = {
    "region": ("r_regionkey", ["r_regionkey", "r_name"]),
    "nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
}


def cells(spark, sf_dir, tables=TABLES, column_types="all"):
    return collection.collection_of(spark, sf_dir, {t: TABLES[t][0] for t in tables}, column_types)


def cells_sql(tables=TABLES) -> str:
    one = lambda t, i, c: f"SELECT '{t}.parquet' AS table_id, {i} AS col_ord, '{c}' AS col_name, row_number() OVER (ORDER BY {TABLES[t][0]}) AS row_ord, CAST({c} AS VARCHAR) AS value FROM {t}"
    return "WITH cells AS (" + " UNION ALL ".join(one(t, i, c) for t in tables for i, c in enumerate(TABLES[t][1])) + "), cols AS (SELECT *, table_id || '::' || col_name AS prompt_id, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS term FROM cells WHERE value IS NOT NULL)"


@register("scan_collection", cells_sql() + " SELECT table_id, col_name, count(*) AS n_rows, count(value) AS n_values, count(DISTINCT value) AS n_distinct FROM cells GROUP BY ALL")
def scan_collection(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("table_id", "col_name").agg(F.count("*").alias("n_rows"), F.count("value").alias("n_values"), F.count_distinct("value").alias("n_distinct"))


@register("scan_string_columns", cells_sql() + " SELECT prompt_id, count(*) AS n FROM cols WHERE col_name IN ('r_name','n_name','s_name','c_name','c_mktsegment','p_name','p_brand','p_type') GROUP BY ALL")
def scan_string_columns(spark, sf_dir):
    return prompts.columns(cells(spark, sf_dir, column_types="string")).groupBy("prompt_id").agg(F.count("*").alias("n"))


FREQ = "(SELECT prompt_id, string_agg(value, ', ' ORDER BY n DESC, value) AS whole FROM (SELECT prompt_id, value, count(*) AS n FROM cols GROUP BY ALL) GROUP BY prompt_id)"


@register("str_cat", cells_sql() + " SELECT prompt_id, substr(string_agg(value, ', ' ORDER BY seen, value), 1, 200) AS prompt FROM (SELECT prompt_id, value, min(row_ord) AS seen FROM cols GROUP BY ALL) GROUP BY prompt_id")
def str_cat(spark, sf_dir):
    return prompts.ColumnStrategy(collate="str_cat", max_length=200).prompts(cells(spark, sf_dir))


@register("freq_cat", cells_sql() + f" SELECT prompt_id, substr(whole, 1, 200) AS prompt FROM {FREQ}")
def freq_cat(spark, sf_dir):
    return prompts.ColumnStrategy(max_length=200).prompts(cells(spark, sf_dir))


_STATS = "(SELECT prompt_id, table_id, col_name, count(*) AS n, min(length(value)) AS lo, max(length(value)) AS hi, printf('%.2f', avg(length(value))) AS me FROM cols GROUP BY ALL)"
_ADAPTED = "'Column ''' || col_name || ''' contains ' || n || ' values with lengths (min, max, mean): (' || lo || ', ' || hi || ', ' || me || '). Values: ' || substr(whole, 1, 150)"


@register("deepjoin_adapted", cells_sql() + f" SELECT prompt_id, {_ADAPTED} AS prompt FROM {_STATS} JOIN {FREQ} USING (prompt_id)")
def deepjoin_adapted(spark, sf_dir):
    return prompts.DeepJoinStrategy(max_length=150).prompts(cells(spark, sf_dir))


@register("deepjoin_original", cells_sql() + f" SELECT prompt_id, table_id || '. ' || col_name || ' contains ' || n || ' values (' || lo || ', ' || hi || ', ' || me || '): ' || whole AS prompt FROM {_STATS} JOIN {FREQ} USING (prompt_id)")
def deepjoin_original(spark, sf_dir):
    return prompts.DeepJoinStrategy(mode="original").prompts(cells(spark, sf_dir))


@register("cell_prompts", cells_sql() + " SELECT prompt_id || '::' || (row_number() OVER (PARTITION BY prompt_id ORDER BY row_ord) - 1) AS prompt_id, value AS prompt FROM cols")
def cell_prompts(spark, sf_dir):
    return prompts.CellStrategy().prompts(cells(spark, sf_dir))


_TERMS = """, tables AS (SELECT table_id, count(DISTINCT col_ord) AS nc, count(value) AS total FROM cells GROUP BY ALL),
 spelled AS (SELECT table_id, prompt_id, term, value, count(*) AS n FROM cols GROUP BY ALL),
 tf AS (SELECT table_id, prompt_id, term, max(n) AS tf, sum(n) AS k FROM spelled GROUP BY ALL),
 terms AS (SELECT t.*, nc, total / nc AS avg_len, count(*) OVER (PARTITION BY t.table_id, term) AS df, sum(k) OVER (PARTITION BY prompt_id) AS len FROM tf t JOIN tables USING (table_id))"""
_TFIDF = "tf * (ln((nc + 1) / (df + 1)) + 1)"
_BM25 = "ln((nc - df + 0.5) / (df + 0.5) + 0.25) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))"


@register("tf_idf_scores", cells_sql() + _TERMS + f" SELECT prompt_id, term, round({_TFIDF}, 6) AS score FROM terms")
def tf_idf_scores(spark, sf_dir):
    return prompts.RankedStrategy(method="tf_idf").scores(cells(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register("bm25_scores", cells_sql() + _TERMS + f" SELECT prompt_id, term, round({_BM25}, 6) AS score FROM terms")
def bm25_scores(spark, sf_dir):
    return prompts.RankedStrategy().scores(cells(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register("ranked_prompts", cells_sql() + _TERMS + f""", o AS (SELECT prompt_id, term, row_number() OVER w AS nth, sum(length(term) + 2) OVER w - 2 AS upto FROM (SELECT prompt_id, term, round({_TFIDF}, 9) AS s FROM terms) WINDOW w AS (PARTITION BY prompt_id ORDER BY s DESC, term))
 SELECT p.prompt_id, coalesce(prompt, '') AS prompt FROM (SELECT DISTINCT prompt_id FROM terms) p LEFT JOIN (SELECT prompt_id, string_agg(term, ', ' ORDER BY nth) AS prompt FROM o WHERE upto <= 120 GROUP BY ALL) USING (prompt_id)""")
def ranked_prompts(spark, sf_dir):
    scores = prompts.RankedStrategy(method="tf_idf").scores(cells(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return prompts.score_cat(scores, max_length=120).withColumnRenamed("text", "prompt")


@register("token_summary", cells_sql() + " SELECT 'hash-cell' AS pipeline, sum(n)::BIGINT AS total, min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean FROM (SELECT len(regexp_extract_all(value, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS n FROM cols)")
def token_summary(spark, sf_dir):
    pipelines = encoders.Pipelines((encoders.HashingEncoder(),), (prompts.CellStrategy(),))
    return pipelines.count_tokens(cells(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@register("first_wins", "SELECT id, name, first_key FROM (SELECT 't::' || replace(replace(p_type, ' ', '::'), '::', ':\\:') AS id, p_type AS name, p_partkey AS first_key, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def first_wins(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(text.column_id(F.lit("t"), F.replace("p_type", F.lit(" "), F.lit("::"))).alias("id"), F.col("p_type").alias("name"), F.col("p_partkey").alias("key"))
    return part.groupBy("id").agg(F.min_by("name", "key").alias("name"), F.min("key").alias("first_key"))


@register("string_functions", "SELECT p_partkey, regexp_replace(lower(p_name), '\\s+', '_', 'g') AS squashed, upper(p_name) AS upper_name, length(p_name) AS n, substr(p_name, 1, 5) AS head, string_split(p_name, ' ')[1] AS first_word, starts_with(p_type, 'S') AS s, printf('%.2f', p_retailprice / 7) AS price, substr(sha256(p_name), 1, 8) AS short FROM part")
def string_functions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", text.squash(F.col("p_name")).alias("squashed"), F.upper("p_name").alias("upper_name"), F.char_length("p_name").alias("n"), F.substring("p_name", 1, 5).alias("head"), F.substring_index("p_name", " ", 1).alias("first_word"), F.startswith("p_type", F.lit("S")).alias("s"), text.two_decimals(F.col("p_retailprice") / 7).alias("price"), F.substring(F.sha2("p_name", 256), 1, 8).alias("short"))


@register("hash_split", "SELECT s AS split, count(*) AS n, round(sum(u), 4) AS total FROM (SELECT u, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS s FROM (SELECT ('0x' || substr(sha1('orders/' || o_orderkey || '.csv'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM orders)) GROUP BY ALL")
def hash_split(spark, sf_dir):
    path = F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"), F.lit(".csv"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(text.hash_split(path).alias("split"), text.unit_of(path).alias("u"))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("u"), 4).alias("total"))


@register("column_names", cells_sql() + " SELECT name, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT split_part(col_name, '_', 2) AS name, count(*) AS n FROM (SELECT DISTINCT table_id, col_name FROM cells) GROUP BY ALL)")
def column_names(spark, sf_dir):
    names = cells(spark, sf_dir).select("table_id", "col_name").distinct().select(F.substring_index("col_name", "_", -1).alias("name"))
    return reports.name_frequency(names).withColumn("share", F.round("share", 6))


_LINES = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | INFO | ' || event_type || ':' || (event_id % 90 + 10) || ' | ' || CASE WHEN event_id % 50 = 0 THEN 'Experiment configuration: {\"id\": ' || event_id || '}' ELSE 'Epoch ' || (event_id % 50) || ', loss: ' || event_id || ', test_acc: ' || (event_id % 7) END"


def _lines(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    message = F.when(i % 50 == 0, F.concat(F.lit('Experiment configuration: {"id": '), i.cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("Epoch "), (i % 50).cast("string"), F.lit(", loss: "), i.cast("string"), F.lit(", test_acc: "), (i % 7).cast("string")))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | INFO | "), F.col("event_type"), F.lit(":"), (i % 90 + 10).cast("string"), F.lit(" | "), message)
    return e.select(F.pmod(F.col("user_id"), F.lit(16)).cast("string").alias("path"), i.alias("line_no"), line.alias("value"))


_PARSED = f"WITH l AS (SELECT user_id % 16 AS path, event_id AS line_no, {_LINES} AS value FROM events), r AS (SELECT path, line_no, regexp_extract(value, '\\| (\\w+):(\\d+) \\|', 1) AS module, regexp_extract(value, '\\| (\\w+):(\\d+) \\|', 2)::INT AS source_line, split_part(value, ' | ', 4) AS message FROM l), x AS (SELECT *, sum(starts_with(message, 'Experiment')::INT) OVER (PARTITION BY path ORDER BY line_no) AS experiment FROM r)"


@register("log_records", _PARSED + " SELECT module, experiment::BIGINT AS experiment, count(*) AS n, sum(source_line)::BIGINT AS total, count(*) FILTER (starts_with(message, 'Experiment')) AS configs FROM x GROUP BY ALL")
def log_records(spark, sf_dir):
    return logs.parse_lines(_lines(spark, sf_dir)).groupBy("module", "experiment").agg(F.count("*").alias("n"), F.sum("source_line").alias("total"), F.count("config").alias("configs"))


@register("log_metrics", _PARSED + ", m AS (SELECT experiment, regexp_extract(message, 'loss: (\\d+)', 1)::DOUBLE AS loss, regexp_extract(message, 'acc: (\\d+)', 1)::DOUBLE AS acc FROM x WHERE starts_with(message, 'Epoch')) SELECT experiment::BIGINT AS experiment, 'epoch' AS kind, 'loss' AS name, count(*) AS n, avg(loss) AS mean FROM m GROUP BY ALL UNION ALL SELECT experiment::BIGINT, 'test', 'acc', count(*), avg(acc) FROM m GROUP BY ALL")
def log_metrics(spark, sf_dir):
    return logs.metrics(logs.parse_lines(_lines(spark, sf_dir))).groupBy("experiment", "kind", "name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@register("request_batches")
def request_batches(spark, sf_dir):
    """Greedy requests for the documents of each source: no SQL, since each request starts its bounds anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", text.n_tokens(F.coalesce("text", F.lit(""))).cast("long").alias("n_tokens"))
    return encoders.request_batches(docs, "source", "doc_id", 20_000, 64)


@register("rate_windows", "SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 6) AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)")
def rate_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return encoders.rate_windows(e, "user_id", "ts", "value", 3600).select("event_id", "requests", F.round("spent", 6).alias("spent"))


@register("hash_embeddings")
def hash_embeddings(spark, sf_dir):
    """Vectors of all columns: Spark's xxhash64 has no DuckDB twin; tests recompute them."""
    strategy = prompts.DeepJoinStrategy(max_length=500)
    return encoders.Pipelines((encoders.HashingEncoder(),), (strategy,)).embed(cells(spark, sf_dir))
