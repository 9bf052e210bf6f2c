"""Round trips through sources and sinks: what is read back equals the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.plans.base import query, table
from citeloom.sources import tables
from citeloom.sources.scratch import scratch
from citeloom.streaming.resume import answer_new


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 200000")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with its filter and columns pushed down."""
    return table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT doc_id, md5(text) AS digest, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents")
def scan_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("source"))
    tables.write_jsonl(rows, path := scratch(spark, "jsonl"))
    return tables.read_jsonl(spark, path, rows.schema).select("doc_id", F.md5("text").alias("digest"), "lang", "source")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def scan_csv_bom_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_mktsegment")
    tables.write_csv(rows, path := scratch(spark, "csv"))
    return tables.read_csv(spark, path)


@query("SELECT count(*) AS chunks, 'documents' AS name FROM documents")
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").count()
    tables.write_manifest(spark, path := scratch(spark, "manifest"), {"chunks": n, "name": "documents"})
    return spark.read.schema("chunks long, name string").json(path)


@query("SELECT doc_id, lang, 0 AS tags, source FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang, 1, NULL FROM documents WHERE lang = 'fr'")
def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    one = rows.filter("lang = 'en'").select("doc_id", "lang", "source")
    two = rows.filter("lang = 'fr'").select("doc_id", "lang", F.array("lang").alias("tags"))
    return tables.unified(one, two, lists=("tags",)).select("doc_id", "lang", F.size("tags").alias("tags"), "source")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey, 'X' FROM orders WHERE o_orderkey % 10 = 3")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed and new rows over an older table, twice: the second time changes nothing."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changed = old.filter("o_orderkey % 10 = 3").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    new = changed.union(changed.select(-F.col("o_orderkey"), "o_orderstatus"))
    return tables.upsert(tables.upsert(old, new, "o_orderkey"), new, "o_orderkey")


@query("SELECT (SELECT count(*) FROM documents WHERE lang = 'en') AS kept, (SELECT count(*) FROM documents WHERE lang IS DISTINCT FROM 'en') AS deleted")
def version_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, others = tables.without_other_versions(table(spark, sf_dir, "documents"), "en", "lang")
    return own.agg(F.count("*").alias("kept")).crossJoin(F.broadcast(others))  # one row each


@query("SELECT count(*) AS chunks, TRUE AS first_built, FALSE AS second_built FROM documents")
def versioned_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build, and the same again, which is skipped."""
    rows, base = table(spark, sf_dir, "documents"), scratch(spark, "build")
    first, second = (tables.build_if_changed(spark, rows, base, ["doc_id", "text"]) for _ in range(2))
    return spark.range(1).select(F.lit(second["chunks"]).cast("long").alias("chunks"), F.lit(first["built"]).alias("first_built"), F.lit(second["built"]).alias("second_built"))


@query("SELECT item_id AS query_id, length(text) AS n FROM benchmark")
def resumable_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in two files, answered in two runs of the same stream; each once."""
    base = scratch(spark, "resume")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    for part in (rows.filter("query_id % 2 = 0"), rows.filter("query_id % 2 = 1 OR query_id % 4 = 0")):
        part.write.mode("append").json(f"{base}/questions")
        answer_new(spark, f"{base}/questions", rows.schema, lambda q: q.select("query_id", F.length("text").alias("n")), f"{base}/answers", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/answers")


@query("SELECT doc_id AS chunk_id, source AS document, n_chars % 7 AS section, 'v' || (doc_id % 3) AS index_version, lang AS jurisdiction FROM documents WHERE doc_id % 3 = 1 AND lang IN ('en', 'fr') AND source = 'src1'")
def chunk_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table by version, jurisdiction and document: other folders and files are not read."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document"), (F.col("n_chars") % 7).alias("section"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("index_version"), F.col("lang").alias("jurisdiction"))
    tables.write_chunk_table(rows, path := scratch(spark, "chunks"))
    return spark.read.parquet(path).filter("index_version = 'v1' AND jurisdiction IN ('en', 'fr') AND document = 'src1'").select(*rows.columns)
