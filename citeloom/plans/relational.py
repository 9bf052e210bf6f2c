"""Projections, filters, joins, aggregates and set operations on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import answers
from citeloom.plans.base import query, table
from citeloom.plans.ranking import TOKENS_SQL, bm25_list, questions, top_sql

REGIONS = {"north": ["de", "en"], "south": ["fr", "en"], "west": ["es", "en"]}
_REGION_SQL = "region_map(region, lang) AS (VALUES ('north', 'de'), ('north', 'en'), ('south', 'fr'), ('south', 'en'), ('west', 'es'), ('west', 'en'))"


def region_map(spark: SparkSession) -> DataFrame:
    """The registry's regions as a table: a fixed number of rows."""
    entries = F.array(*(F.struct(F.lit(r).alias("region"), F.lit(lang).alias("lang")) for r, langs in REGIONS.items() for lang in langs))
    return spark.range(1).select(F.explode(entries).alias("e")).select("e.region", "e.lang")


@query(f"WITH {_REGION_SQL} SELECT r.region, count(*) AS documents, sum(d.n_chars) AS chars FROM region_map r JOIN documents d USING (lang) GROUP BY r.region")
def registry_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(F.broadcast(region_map(spark)), "lang")  # six rows
    return rows.groupBy("region").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("SELECT doc || '_s' || section AS chunk_id, doc, section, 'listed' AS status FROM (VALUES ('a', ['1', '2', '2A']), ('b', ['1', '9'])) v(doc, sections), unnest(sections) u(section)")
def declared_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows that the registry declares inline."""
    declared = F.array(F.struct(F.lit("a").alias("doc"), F.array(F.lit("1"), F.lit("2"), F.lit("2A")).alias("sections")), F.struct(F.lit("b").alias("doc"), F.array(F.lit("1"), F.lit("9")).alias("sections")))
    rows = spark.range(1).select(F.explode(declared).alias("d")).select("d.doc", F.explode("d.sections").alias("section"))
    return rows.select(F.concat("doc", F.lit("_s"), "section").alias("chunk_id"), "doc", "section", F.lit("listed").alias("status"))


@query("SELECT p_partkey, concat_ws(' ', nullif(p_brand, ''), nullif(CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END, ''), nullif(p_type, '')) AS index_text FROM part")
def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.joined_parts(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""), F.col("p_type")).alias("index_text"))


@query("SELECT p_partkey, upper(left(p_brand, 2)) || '_s' || p_size || '_def_' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS chunk_id, p_brand || ', s. ' || p_size || '(1)' AS citation FROM part")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.concat(F.upper(F.substring("p_brand", 1, 2)), F.lit("_s"), F.col("p_size").cast("string"), F.lit("_def_"), T.slug(F.col("p_name")))
    return part.select("p_partkey", name.alias("chunk_id"), F.format_string("%s, s. %d(1)", "p_brand", "p_size").alias("citation"))


@query("SELECT p_partkey, p_brand || '_s' || p_size || repeat('_x', CAST(row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS INT)) AS chunk_id FROM part")
def chunk_ids_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")) - 1
    return table(spark, sf_dir, "part").withColumn("n", again).select("p_partkey", F.concat("p_brand", F.lit("_s"), F.col("p_size").cast("string"), F.expr("repeat('_x', n)")).alias("chunk_id"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS parse_rule FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of raw JSON as text, then as a number."""
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("parse_rule"))


@query("""SELECT doc_id AS chunk_id, 'v' || (doc_id % 3) AS index_version, lang AS jurisdiction, source AS document, 'plain' AS parse_rule, n_chars % 7 AS section, doc_id AS doc_order,
    '{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || ',"n_chars":' || coalesce(n_chars::VARCHAR, 'null') || '}' AS metadata FROM documents""")
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the chunk table: seven columns to filter by, and the whole record as JSON with its nulls."""
    record = F.to_json(F.struct("doc_id", "lang", "source", "n_chars"), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("index_version"), F.col("lang").alias("jurisdiction"), F.col("source").alias("document"),
        F.lit("plain").alias("parse_rule"), (F.col("n_chars") % 7).alias("section"), F.col("doc_id").alias("doc_order"), record.alias("metadata"),
    )


@query(f"WITH {TOKENS_SQL}, {top_sql('t', 'bm25', 3)} SELECT t.query_id, t.rank AS number, d.doc_id AS chunk_id, d.lang AS jurisdiction, d.source AS statute, t.score, md5(d.text) AS content_digest FROM t JOIN documents d USING (doc_id)")
def citation_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved chunks as nested citations, flattened again for the comparison."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("jurisdiction"), F.col("source").alias("statute"), F.md5("text").alias("content_digest")).alias("chunk"))
    nested = bm25_list(spark, sf_dir, 3).join(documents, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("number"), "score", "chunk"))).alias("citations"))
    flat = nested.select("query_id", F.explode("citations").alias("c"))
    return flat.select("query_id", "c.number", "c.chunk.chunk_id", "c.chunk.jurisdiction", "c.chunk.statute", "c.score", "c.chunk.content_digest")


@query("SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') AS long_date FROM orders")
def long_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.long_date(F.col("o_orderdate")).alias("long_date"))


@query("SELECT o_orderkey, 'A' || o_orderkey || '_p' || (o_orderkey % 40) AS chunk_id, 'Award No. ' || o_orderkey || ' (' || strftime(o_orderdate, '%-d %B %Y') || '), para. ' || (o_orderkey % 40) AS citation, o_orderkey % 40 BETWEEN 3 AND 9 OR o_orderkey % 40 >= 30 AS is_reasoning FROM orders")
def award_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 40
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.format_string("A%d_p%d", "o_orderkey", n).alias("chunk_id"), F.format_string("Award No. %d (%s), para. %d", "o_orderkey", T.long_date(F.col("o_orderdate")), n).alias("citation"), (n.between(3, 9) | (n >= 30)).alias("is_reasoning")
    )


@query("WITH e AS (SELECT n_regionkey, list('not ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' to (' || n_nationkey || ')' ELSE '' END ORDER BY n_nationkey) AS x FROM nation GROUP BY n_regionkey) SELECT r_regionkey, r_name || chr(10) || array_to_string(x, chr(10)) AS content FROM region JOIN e ON n_regionkey = r_regionkey")
def row_exclusion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule row's text with its exclusions as lines."""
    nation = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    line = F.transform("x", lambda s: F.concat(F.lit("not "), s["n_name"], F.when(s["n_nationkey"] % 2 == 0, F.concat(F.lit(" to ("), s["n_nationkey"].cast("string"), F.lit(")"))).otherwise("")))
    return table(spark, sf_dir, "region").join(nation, "r_regionkey").select("r_regionkey", F.concat("r_name", F.lit("\n"), F.array_join(line, "\n")).alias("content"))


@query("""WITH c AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Order' ELSE n_name END AS statute, n_name || ', s. ' || n_nationkey || '(1)' AS citation FROM nation)
    SELECT n_nationkey, CASE WHEN starts_with(citation, statute || ', ') THEN substr(citation, length(statute) + 3) ELSE citation END AS section_ref, CASE WHEN starts_with(citation, statute || ', ') THEN substr(citation, length(statute) + 3) || ', ' || statute ELSE citation END AS chip FROM c""")
def citation_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without the statute in front, and labels with it behind; every third citation is another's."""
    statute = F.when(F.col("n_nationkey") % 3 == 0, "Order").otherwise(F.col("n_name"))
    citation = F.concat("n_name", F.lit(", s. "), F.col("n_nationkey").cast("string"), F.lit("(1)"))
    return table(spark, sf_dir, "nation").select("n_nationkey", answers.section_ref(citation, statute).alias("section_ref"), answers.chip_label(citation, statute).alias("chip"))


@query("SELECT doc_id, doc_id % 3 AS version FROM documents WHERE doc_id % 3 = 1")
def version_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("version")).filter("version = 1")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 3 AND 5 OR l_quantity >= 45")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A union of inclusive ranges, the last one open."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").filter(q.between(3, 5) | (q >= 45)).select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey FROM supplier WHERE 'IRA_s' || s_suppkey = 'IRA_s5' OR starts_with('IRA_s' || s_suppkey || '_1', 'IRA_s5_')")
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IRA_s5 matches itself and IRA_s5_..., not IRA_s59_1."""
    name = F.concat(F.lit("IRA_s"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").filter((name == "IRA_s5") | F.startswith(F.concat(name, F.lit("_1")), F.lit("IRA_s5_"))).select("s_suppkey")


@query(f"WITH {TOKENS_SQL}, {top_sql('t', 'bm25', 5)} SELECT t.query_id, t.doc_id FROM t JOIN documents d USING (doc_id) WHERE d.lang NOT IN ('fr', 'en')")
def region_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_list(spark, sf_dir, 5).join(table(spark, sf_dir, "documents").filter(~F.col("lang").isin("fr", "en")).select("doc_id"), "doc_id", "left_semi").select("query_id", "doc_id")


@query(f"""WITH {TOKENS_SQL}, {top_sql('t', 'bm25', 5)}, c AS (SELECT t.query_id, t.doc_id, CASE WHEN t.doc_id % 5 = 0 THEN 'deleted' WHEN t.doc_id % 5 = 1 THEN 'superseded' ELSE 'in_force' END AS status, t.doc_id + 1 AS amended_by FROM t)
    SELECT query_id, doc_id FROM c WHERE status = 'deleted' OR (status = 'superseded' AND NOT EXISTS (SELECT 1 FROM c o WHERE o.query_id = c.query_id AND o.doc_id = c.amended_by))""")
def non_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited chunks that are not in force, or superseded with no amending chunk cited."""
    status = F.when(F.col("doc_id") % 5 == 0, "deleted").when(F.col("doc_id") % 5 == 1, "superseded").otherwise("in_force")
    cited = bm25_list(spark, sf_dir, 5).select("query_id", "doc_id", status.alias("status"), F.array(F.col("doc_id") + 1).alias("amended_by"))
    every = cited.groupBy("query_id").agg(F.collect_list("doc_id").alias("cited"))
    return cited.join(every, "query_id").filter(answers.non_current(F.col("status"), F.col("amended_by"), F.col("cited"))).select("query_id", "doc_id")


@query("SELECT doc_id, length(trim(text)) BETWEEN 1 AND 2000 AS ok FROM documents")
def query_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.trim("text")).between(1, 2000).alias("ok"))


_PLACEHOLDERS = ("(Omitted).", "[Deleted by Act A{k}]", "(Deleted)", "{n}", "[Repealed by *Act {k} of 1966.]", "(Deleted items must be returned) by hand", "[Deleted  by AA{k}]", "(Deleted Act A{k}.).")
_PLACEHOLDER_FORM = r"(?i)^[\[(](Deleted|Omitted|Repealed)(?: by)?(?: (.+?))?\.?[\])]\.?$"


@query(f"""WITH p AS (SELECT p_partkey, replace(replace([{', '.join(map(repr, _PLACEHOLDERS))}][p_size % {len(_PLACEHOLDERS)} + 1], '{{k}}', p_partkey::VARCHAR), '{{n}}', p_name) AS t FROM part), c AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(t, '\\*+([\\w(])', '\\1', 'g'), '\\s+', ' ', 'g')) AS t FROM p)
    SELECT p_partkey, CASE lower(regexp_extract(t, '{_PLACEHOLDER_FORM}', 1)) WHEN '' THEN NULL WHEN 'omitted' THEN 'omitted' ELSE 'deleted' END AS status, nullif(regexp_extract(t, '{_PLACEHOLDER_FORM}', 2), '') AS instrument FROM c""".replace("\\\\", "\\"))
def placeholder_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*(F.replace(F.replace(F.lit(f), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{n}"), F.col("p_name")) for f in _PLACEHOLDERS))
    found = answers.placeholder(F.get(forms, (F.col("p_size") % len(_PLACEHOLDERS)).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", found["status"].alias("status"), found["instrument"].alias("instrument"))


@query("SELECT p_partkey, regexp_matches(p_name, '^[A-Z]') AND len(string_split(p_name, ' ')) <= 3 AS heading FROM part")
def heading_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.rlike("p_name", F.lit("^[A-Z]")) & (F.size(F.split("p_name", " ")) <= 3)).alias("heading"))


@query("SELECT o.o_custkey, min(o.o_orderkey) AS first_order, c.c_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY o.o_custkey, c.c_name")
def first_match_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))
    return first.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left").select("o_custkey", "first_order", "c_name")


@query("SELECT b.item_id || '-ms' AS id, d.lang, md5(d.text) AS digest FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3 WHERE d.text <> '' AND d.lang <> 'en'")
def translated_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold items joined with another wording where there is one."""
    wording = table(spark, sf_dir, "documents").filter("text <> '' AND lang <> 'en'").select(F.col("doc_id").alias("key"), "lang", F.md5("text").alias("digest"))
    gold = questions(spark, sf_dir).select("query_id", (F.col("query_id") * 3).alias("key"))
    return gold.join(wording, "key").select(F.concat(F.col("query_id").cast("string"), F.lit("-ms")).alias("id"), "lang", "digest")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query("""WITH w AS (SELECT user_id, event_id, value AS lo, value + 5 AS hi FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id AS bar, value AS x0, value + 3 AS x1 FROM events WHERE event_type = 'click')
    SELECT w.event_id, count(*) AS bars FROM w JOIN b ON b.user_id = w.user_id AND b.x0 < w.hi AND b.x1 > w.lo GROUP BY w.event_id""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that overlap drawn bars on the same page."""
    events = table(spark, sf_dir, "events")
    word = events.filter("event_type = 'view'").select("user_id", "event_id", F.col("value").alias("lo"), (F.col("value") + 5).alias("hi"))
    bar = events.filter("event_type = 'click'").select("user_id", F.col("value").alias("x0"), (F.col("value") + 3).alias("x1"))
    return word.join(bar, "user_id").filter((F.col("x0") < F.col("hi")) & (F.col("x1") > F.col("lo"))).groupBy("event_id").agg(F.count("*").alias("bars"))


@query(f"""WITH {TOKENS_SQL}, {top_sql('t', 'bm25', 5)}, a AS (SELECT item_id AS query_id, 'See [' || (item_id % 5 + 1) || '] and [' || (item_id % 7 + 1) || '].' AS answer FROM benchmark), m AS (
        SELECT query_id, CAST(unnest(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1)) AS INT) AS block, generate_subscripts(regexp_extract_all(answer, '\\[([0-9]+)\\]', 1), 1) AS at_ FROM a)
    SELECT m.query_id, m.at_ - 1 AS position, m.block, t.doc_id FROM m LEFT JOIN t ON t.query_id = m.query_id AND t.rank = m.block""")
def marker_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of an answer joined with the blocks they name; no block for an invalid one."""
    text = F.format_string("See [%d] and [%d].", F.col("query_id") % 5 + 1, F.col("query_id") % 7 + 1)
    marks = questions(spark, sf_dir).select("query_id", F.posexplode(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1))).alias("position", "block"))
    marks = marks.select("query_id", F.col("position").cast("long").alias("position"), F.col("block").cast("int").alias("block"))
    blocks = bm25_list(spark, sf_dir, 5).select("query_id", F.col("rank").alias("block"), "doc_id")
    return marks.join(blocks, ["query_id", "block"], "left").select("query_id", "position", "block", "doc_id")


@query("""WITH m AS (SELECT doc_id, list_filter([{'p': strpos(text, 'License'), 'n': 'License'}, {'p': strpos(text, 'GNU'), 'n': 'GNU'}, {'p': strpos(text, 'Apache'), 'n': 'Apache'}], lambda x: x.p > 0) AS f FROM documents)
    SELECT doc_id, array_to_string(list_transform(list_sort(f), lambda x: x.n), ',') AS mentioned FROM m WHERE len(f) > 0""")
def mention_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names mentioned in a text, by first position."""
    at = F.array(*(F.struct(F.instr("text", n).alias("p"), F.lit(n).alias("n")) for n in ("License", "GNU", "Apache")))
    found = F.array_sort(F.filter(at, lambda s: s["p"] > 0))
    return table(spark, sf_dir, "documents").filter(F.size(found) > 0).select("doc_id", F.array_join(F.transform(found, lambda s: s["n"]), ",").alias("mentioned"))


@query("WITH f AS (SELECT l_orderkey, l_shipdate, l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM lineitem) SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS flags FROM f WHERE n = 1 GROUP BY l_orderkey")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in order of their first occurrence."""
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return by.select("l_orderkey", F.array_join(F.array_distinct(F.transform("x", lambda s: s["l_returnflag"])), ",").alias("flags"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS dependencies FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def external_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("x"))
    return by.select("o_custkey", F.array_join(F.array_sort("x"), ",").alias("dependencies"))


@query("SELECT l_orderkey, arg_min(l_partkey, {'n': l_linenumber, 'p': l_partkey}) AS first_page, arg_max(l_partkey, {'n': l_linenumber, 'p': l_partkey}) AS last_page FROM lineitem GROUP BY l_orderkey")
def first_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", at).alias("first_page"), F.max_by("l_partkey", at).alias("last_page"))


@query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, arg_max(o_orderpriority, {'n': n, 'p': o_orderpriority}) AS style FROM c GROUP BY o_custkey")
def argmax_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return by.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("n", "o_orderpriority")).alias("style"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 100000) AS passed, count(*) AS total FROM orders GROUP BY o_orderpriority")
def pass_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 100000).alias("passed"), F.count("*").alias("total"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]'), lambda s: len(regexp_extract_all(s, '[A-Za-z]+')) >= 6 AND NOT regexp_matches(s, '\\[[0-9]'))) AS uncited FROM documents")
def uncited_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = F.split("text", "(?<=[.!?])")  # one pass; what has no end is the last part
    bare = F.filter(sentences, lambda s: F.rlike(s, F.lit("[.!?]$")) & (F.regexp_count(s, F.lit("[A-Za-z]+")) >= 6) & ~F.rlike(s, F.lit(r"\[[0-9]")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(bare).cast("long").alias("uncited"))


@query("WITH f AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][A-Za-z]+ (?:License|Public License)') AS x FROM documents) SELECT doc_id, array_to_string(list_filter(x, lambda n, i: list_position(x, n) = i), '|') AS refs FROM f WHERE len(x) > 0")
def external_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("([A-Z][A-Za-z]+ (?:License|Public License))"), F.lit(1))
    return table(spark, sf_dir, "documents").filter(F.size(found) > 0).select("doc_id", F.array_join(F.array_distinct(found), "|").alias("refs"))


@query(f"""WITH {TOKENS_SQL}, {top_sql('t', 'bm25', 3)}, b AS (SELECT t.query_id, t.rank, '[' || t.rank || '] ' || concat_ws(' | ', d.source || ', s. ' || d.doc_id, nullif('', ''), d.lang, upper(CASE WHEN d.doc_id % 2 = 0 THEN 'in_force' ELSE 'superseded' END)) || chr(10) || d.text AS block FROM t JOIN documents d USING (doc_id))
    SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY query_id""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("source"), F.col("lang"), F.col("text").alias("content"))
    status = F.when(F.col("doc_id") % 2 == 0, "in_force").otherwise("superseded")
    rows = bm25_list(spark, sf_dir, 3).join(documents, "doc_id").select("query_id", "rank", F.format_string("%s, s. %d", "source", "doc_id").alias("citation"), F.lit("").alias("title"), "lang", status.alias("status"), "content")
    block = answers.context_block(F.col("rank"), F.col("citation"), F.col("title"), F.col("lang"), F.col("status"), F.col("content"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda s: s["block"]), "\n\n").alias("context"))


@query("SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'Please ask in English.' WHEN 1 THEN 'No passage was found. Held: src1; src2.' ELSE 'No passage answers this well enough. Held: src1; src2.' END AS message FROM benchmark")
def abstention_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("query_id") % 3 == 0, "language").when(F.col("query_id") % 3 == 1, "no_candidates").otherwise("low_score")
    return questions(spark, sf_dir).select("query_id", answers.abstention_message(reason, F.array(F.lit("src1"), F.lit("src2"))).alias("message"))


@query("SELECT doc_id, left(sha256(text), 12) AS version FROM documents")
def content_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_version(F.encode("text", "UTF-8")).alias("version"))


@query("""WITH e AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN ['stage:retrieving', 'retrieval', 'answer'] WHEN 1 THEN ['stage:retrieving', 'error'] ELSE ['stage:retrieving', 'retrieval', 'stage:generating', 'answer'] END AS x FROM benchmark)
    SELECT query_id, generate_subscripts(x, 1) AS seq, unnest(x) AS event FROM e""")
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered messages of each request: an abstained one is not generated, a failed one ends with the error."""
    k = F.col("query_id") % 4
    rows = questions(spark, sf_dir).select("query_id", (k == 0).alias("abstained"), (k == 1).alias("failed"))
    return rows.select("query_id", F.posexplode(answers.stages(F.col("abstained"), F.col("failed"))).alias("n", "event")).select("query_id", (F.col("n") + 1).alias("seq"), "event")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def union_all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    parts = [rows.filter("lang = 'en'"), rows.filter("lang = 'fr'"), rows.filter("source = 'src1'")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id").union(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents WHERE lang = 'de' INTERSECT SELECT doc_id FROM labels WHERE toxic = 0")
def intersect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("lang = 'de'").select("doc_id").intersect(table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT 'only_first' AS side, doc_id, source FROM (SELECT doc_id, source FROM documents EXCEPT ALL SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN 'changed' ELSE source END FROM documents) UNION ALL SELECT 'only_second', doc_id, source FROM (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN 'changed' ELSE source END AS source FROM documents EXCEPT ALL SELECT doc_id, source FROM documents)")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that only one of two runs has."""
    one = table(spark, sf_dir, "documents").select("doc_id", "source")
    two = one.withColumn("source", F.when(F.col("doc_id") % 100 == 7, "changed").otherwise(F.col("source")))
    return one.exceptAll(two).select(F.lit("only_first").alias("side"), "doc_id", "source").union(two.exceptAll(one).select(F.lit("only_second"), "doc_id", "source"))


@query("SELECT vec_id, len(embedding) AS dim, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(list_max(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS most, len(list_filter(embedding, lambda x: x > 0.1)) AS heavy FROM embeddings")
def array_map_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense vector as a sparse map of its heavy weights, and array functions."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sparse = F.map_from_entries(F.filter(F.transform("embedding", lambda c, i: F.struct(i.cast("string").alias("token"), c.cast("float").alias("weight"))), lambda s: s["weight"] > F.lit(0.1)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.element_at(x, 1), 5).alias("first"), F.round(F.array_max(x), 5).alias("most"), F.size(sparse).cast("long").alias("heavy"))


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS t FROM n), q AS (SELECT source, n, greatest(1, CAST(round_even(60 * n / t, 0) AS BIGINT)) AS quota FROM n, t),
    a AS (SELECT *, 60 - sum(quota) OVER () AS rest, row_number() OVER (ORDER BY n DESC, source) AS r FROM q), f AS (SELECT source, CASE WHEN r = 1 THEN quota + rest ELSE quota END AS quota FROM a),
    s AS (SELECT d.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY md5('42-' || d.doc_id), d.doc_id) AS k FROM documents d)
    SELECT s.source, s.doc_id FROM s JOIN f USING (source) WHERE s.k <= f.quota""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample without replacement, by a proportional quota of each source."""
    return answers.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 60, 42).select("source", "doc_id")
