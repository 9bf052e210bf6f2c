"""Link expansion and status over groups of identical documents: an older copy is amended by the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.operators import links
from citeloom.plans.base import query, table
from citeloom.plans.ranking import TOKENS_SQL, bm25_list, top_sql

LINKS_SQL = """
    grp AS (SELECT doc_id, md5(text) AS h, max(doc_id) OVER (PARTITION BY md5(text)) AS newest FROM documents),
    lnk AS (
        SELECT doc_id AS src_id, newest AS dst_id, 'amended_by' AS kind, 0 AS ord FROM grp WHERE doc_id <> newest
        UNION ALL SELECT newest, doc_id, 'amends', row_number() OVER (PARTITION BY newest ORDER BY doc_id) - 1 FROM grp WHERE doc_id <> newest
    ), chunk AS (SELECT doc_id AS chunk_id, source AS doc, CAST(n_chars % 7 AS VARCHAR) AS section, lang AS jurisdiction, doc_id AS doc_order, n_chars % 3 = 0 AS is_definition FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), (F.col("n_chars") % 7).cast("string").alias("section"), F.col("lang").alias("jurisdiction"), F.col("doc_id").alias("doc_order"), (F.col("n_chars") % 3 == 0).alias("is_definition")
    )


def link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    newest = rows.groupBy("h").agg(F.max("doc_id").alias("newest"), F.count("*").alias("n")).filter("n > 1").select("h", "newest")
    pairs = rows.join(newest, "h").filter("doc_id <> newest")
    return pairs.select(F.col("doc_id").alias("src_id"), F.col("newest").alias("dst_id"), F.lit("amended_by").alias("kind"), F.lit(0).cast("long").alias("ord")).union(
        pairs.select("newest", "doc_id", F.lit("amends"), "doc_id")
    )


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_list(spark, sf_dir, 5).select("query_id", F.col("doc_id").alias("chunk_id"), "rank")


@query(f"WITH {TOKENS_SQL}, {top_sql('r', 'bm25', 5)}, {LINKS_SQL} SELECT r.query_id, r.rank AS trigger_rank, r.doc_id AS trigger, l.dst_id AS candidate FROM r JOIN lnk l ON l.src_id = r.doc_id AND l.kind = 'amended_by'")
def expand_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.forward(_retrieved(spark, sf_dir), link_table(spark, sf_dir)).select("query_id", "trigger_rank", "trigger", "candidate")


@query(f"""WITH {TOKENS_SQL}, {top_sql('r', 'bm25', 5)}, {LINKS_SQL} SELECT r.query_id, r.doc_id AS trigger, d.chunk_id AS candidate FROM r JOIN chunk c ON c.chunk_id = r.doc_id
    JOIN chunk d ON d.doc = c.doc AND d.section = c.section AND d.is_definition WHERE c.section <> '2'""")
def expand_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.definitions(_retrieved(spark, sf_dir), chunks(spark, sf_dir), F.col("is_definition")).select("query_id", "trigger", "candidate")


@query(f"""WITH {TOKENS_SQL}, {top_sql('r', 'bm25', 5)}, {LINKS_SQL} SELECT query_id, trigger, candidate, position FROM (
        SELECT r.query_id, r.doc_id AS trigger, l.dst_id AS candidate, row_number() OVER (PARTITION BY r.query_id, r.doc_id ORDER BY l.dst_id) AS position FROM r JOIN lnk l ON l.src_id = r.doc_id AND l.kind = 'amends') WHERE position <= 3""")
def expand_reverse_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = links.reverse(_retrieved(spark, sf_dir), link_table(spark, sf_dir), chunks(spark, sf_dir))
    position = F.row_number().over(Window.partitionBy("query_id", "trigger").orderBy("ord"))
    return hops.withColumn("position", position).filter(F.col("position") <= links.REVERSE_CAP).select("query_id", "trigger", "candidate", "position")


@query(f"""WITH RECURSIVE {TOKENS_SQL}, {top_sql('r', 'bm25', 5)}, {LINKS_SQL}, hop AS (
        SELECT r.query_id, 1 AS pass, r.rank, r.doc_id AS trigger, l.ord, l.dst_id AS candidate FROM r JOIN lnk l ON l.src_id = r.doc_id AND l.kind = 'amended_by'
        UNION ALL SELECT r.query_id, 2, r.rank, r.doc_id, d.doc_order, d.chunk_id FROM r JOIN chunk c ON c.chunk_id = r.doc_id JOIN chunk d ON d.doc = c.doc AND d.section = c.section AND d.is_definition WHERE c.section <> '2'
        UNION ALL SELECT r.query_id, 3, r.rank, r.doc_id, l.dst_id, l.dst_id FROM r JOIN lnk l ON l.src_id = r.doc_id AND l.kind = 'amends'
    ), offer AS (
        SELECT h.*, c.jurisdiction IN ('en', 'fr') AS ok FROM hop h JOIN chunk c ON c.chunk_id = h.candidate WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = h.query_id AND r.doc_id = h.candidate)
    ), early AS (
        SELECT query_id, pass, rank, ord, candidate, trigger FROM (SELECT *, row_number() OVER (PARTITION BY query_id, candidate ORDER BY pass, rank, ord) AS n FROM offer WHERE pass < 3 AND ok) WHERE n = 1
    ), late AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, ord) AS n FROM offer WHERE pass = 3
    ), fold(query_id, n, trigger, slots, offered, added) AS (
        SELECT q.query_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0, coalesce((SELECT list(candidate) FROM early e WHERE e.query_id = q.query_id), []), CAST([] AS BIGINT[]) FROM (SELECT DISTINCT query_id FROM r) q
        UNION ALL
        SELECT f.query_id, l.n, l.trigger,
            CASE WHEN list_contains(f.offered, l.candidate) OR (f.trigger IS NOT DISTINCT FROM l.trigger AND f.slots >= 3) THEN CASE WHEN f.trigger IS NOT DISTINCT FROM l.trigger THEN f.slots ELSE 0 END
                 ELSE CASE WHEN f.trigger IS NOT DISTINCT FROM l.trigger THEN f.slots ELSE 0 END + 1 END,
            CASE WHEN NOT list_contains(f.offered, l.candidate) AND NOT (f.trigger IS NOT DISTINCT FROM l.trigger AND f.slots >= 3) AND l.ok THEN list_append(f.offered, l.candidate) ELSE f.offered END,
            CASE WHEN NOT list_contains(f.offered, l.candidate) AND NOT (f.trigger IS NOT DISTINCT FROM l.trigger AND f.slots >= 3) AND l.ok THEN [l.candidate, l.n] ELSE [] END
        FROM fold f JOIN late l ON l.query_id = f.query_id AND l.n = f.n + 1
    ), every AS (
        SELECT query_id, pass, rank, ord, candidate, trigger FROM early
        UNION ALL SELECT f.query_id, 3, l.rank, l.ord, l.candidate, l.trigger FROM fold f JOIN late l ON l.query_id = f.query_id AND l.n = f.n WHERE len(f.added) > 0
    ), placed AS (
        SELECT e.*, row_number() OVER (PARTITION BY query_id ORDER BY pass, rank, ord, candidate) AS position, count(*) OVER (PARTITION BY query_id) AS n, 12 - (SELECT count(*) FROM r WHERE r.query_id = e.query_id) AS room FROM every e
    )
    SELECT query_id, candidate AS chunk_id, CASE pass WHEN 1 THEN 'amendment_of' WHEN 2 THEN 'definition_for' ELSE 'amended_by' END AS why, trigger, CAST(position AS INT) AS position, CAST(greatest(0, n - room) AS INT) AS dropped
    FROM placed WHERE position <= room""")
def expand_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    retrieved = _retrieved(spark, sf_dir)
    allowed = retrieved.select("query_id").distinct().select("query_id", F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("jurisdiction"))
    return links.expand(retrieved, link_table(spark, sf_dir), chunks(spark, sf_dir), F.col("is_definition"), allowed)


@query(f"""WITH {LINKS_SQL}, e AS (SELECT l.src_id, l.dst_id, l.ord, CASE WHEN l.dst_id % 4 = 0 THEN 'delete' ELSE 'amend' END AS action FROM lnk l WHERE kind = 'amends')
    SELECT dst_id AS chunk_id, CASE WHEN bool_or(action = 'delete') THEN 'deleted' ELSE 'superseded' END AS status, min(src_id) FILTER (WHERE action = 'delete') AS deleted_by FROM e GROUP BY dst_id""")
def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = link_table(spark, sf_dir).filter("kind = 'amends'").withColumn("action", F.when(F.col("dst_id") % 4 == 0, "delete").otherwise("amend"))
    return links.status(edges)


@query(f"""WITH {LINKS_SQL}, p AS (SELECT l.src_id, l.dst_id, d.lang = 'en' AND d.doc_id % 2 = 0 AS m FROM lnk l JOIN documents d ON d.doc_id = l.dst_id WHERE l.kind = 'amends')
    SELECT src_id, dst_id FROM (SELECT *, bool_or(m) OVER (PARTITION BY src_id) AS a FROM p) WHERE m OR NOT a""")
def narrow_or_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = link_table(spark, sf_dir).filter("kind = 'amends'").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("dst_id"), "lang"), "dst_id")
    return links.narrowed(pairs, "src_id", (F.col("lang") == "en") & (F.col("dst_id") % 2 == 0)).select("src_id", "dst_id")


@query(f"WITH {LINKS_SQL}, s AS (SELECT CASE WHEN dst_id % 4 = 0 THEN 'deleted' ELSE 'superseded' END AS status FROM lnk WHERE kind = 'amends') SELECT count(*) FILTER (WHERE status = 'superseded') AS superseded, count(*) FILTER (WHERE status = 'deleted') AS deleted FROM s")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_status(spark, sf_dir)
    return found.agg(F.count_if(F.col("status") == "superseded").alias("superseded"), F.count_if(F.col("status") == "deleted").alias("deleted"))
