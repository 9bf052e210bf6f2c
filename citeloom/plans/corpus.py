"""Corpus queries: page lines, furniture, headings, blocks, anchors, validation, windows and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import validate
from citeloom.plans.base import query, table

_WORDS = ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS)
LINES_SQL = "line AS (SELECT source, doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, len(string_split(text, chr(10))) AS n FROM documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source (the document), page, line_no (from 1), line, n (lines of the page)."""
    own = table(spark, sf_dir, "documents").withColumn("lines", F.split("text", "\n", -1))
    return own.select("source", F.col("doc_id").alias("page"), F.posexplode("lines").alias("at", "line"), F.size("lines").alias("n")).select("source", "page", (F.col("at") + 1).cast("long").alias("line_no"), "line", F.col("n").cast("long").alias("n"))


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


@query(f"WITH {LINES_SQL} SELECT page, line_no, md5(line) AS digest FROM line")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("page", "line_no", F.md5("line").alias("digest"))


@query("SELECT source, doc_id AS page, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS printed_page FROM documents QUALIFY printed_page BETWEEN 3 AND 7")
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 3 to 7 of each document, numbered by position."""
    number = F.row_number().over(Window.partitionBy("source").orderBy("page"))
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page")).withColumn("printed_page", number).filter(F.col("printed_page").between(3, 7))


SIGNATURE_SQL = r"regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '[0-9]+', '#', 'g')"


@query(f"""WITH {LINES_SQL}, e AS (SELECT source, page, line_no, n, {SIGNATURE_SQL} AS sig FROM line WHERE length(trim(line)) > 0), s AS (
        SELECT source, page, 'top' || (line_no - 1) AS slot, sig FROM e WHERE line_no <= 2 UNION ALL SELECT source, page, 'bot' || (n - line_no), sig FROM e WHERE n - line_no < 2
    ), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source)
    SELECT s.source, s.slot, s.sig AS signature, count(DISTINCT page) AS pages FROM s JOIN p USING (source) GROUP BY s.source, s.slot, s.sig, p.pages HAVING count(DISTINCT page) >= greatest(2, CAST(floor(0.05 * p.pages) AS BIGINT))""")
def furniture_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lines that repeat over a document's pages (share lowered to 0.05 for these tables)."""
    return validate.furniture_signatures(lines(spark, sf_dir), share=0.05)


@query(f"""WITH {LINES_SQL}, e AS (SELECT DISTINCT source, page, regexp_replace(line, '[0-9]', '#', 'g') AS shape FROM line WHERE length(trim(line)) > 0 AND (line_no <= 3 OR n - line_no < 3)), p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source)
    SELECT e.source, e.shape, count(*) AS n FROM e JOIN p USING (source) WHERE p.pages >= 3 GROUP BY e.source, e.shape, p.pages HAVING count(*) >= greatest(3, p.pages / 25)""")
def award_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.award_furniture(lines(spark, sf_dir), share=0.04)


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations""")
def carry_forward_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.when(F.col("role") == "user", F.col("text"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(heading, ignorenulls=True).over(w).alias("heading"))


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM g)
    SELECT user_id, CAST(block AS BIGINT) AS block, count(*) AS cells, min(event_id) AS first_event FROM b GROUP BY user_id, block""")
def gap_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands: a user's events at most six hours apart form a block."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return validate.blocks(rows, ["user_id"], ["ts", "event_id"], _seconds("ts"), 6 * 3600).groupBy("user_id", "block").agg(F.count("*").alias("cells"), F.min("event_id").alias("first_event"))


@query("""WITH a AS (SELECT user_id, ts, max(event_id) AS anchor FROM events WHERE event_type = 'click' GROUP BY user_id, ts), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, a.anchor FROM p ASOF LEFT JOIN a ON p.user_id = a.user_id AND p.ts >= a.ts""")
def asof_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click at or before each purchase of the same user."""
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select("user_id", _seconds("ts").alias("ts"), "event_id")
    right = events.filter("event_type = 'click'").groupBy("user_id", _seconds("ts").alias("ts")).agg(F.max("event_id").alias("anchor"))
    return validate.asof(left, right, ["user_id"], "ts", "anchor").select("event_id", "anchor")


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS stop_turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn + 1) - turn AS span FROM conversations WHERE role = 'user'")
def lead_section_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.lead("turn").over(w).alias("stop_turn"))
    return rows.withColumn("span", F.coalesce("stop_turn", F.col("turn") + 1) - F.col("turn"))


@query("SELECT conv_id, turn, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS siblings FROM conversations")
def doc_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk with all chunk ids of its section, in order."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    siblings = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string")), ",").alias("siblings"))
    return rows.join(siblings, "conv_id").select("conv_id", "turn", "siblings")


GATE_SQL = f"""w AS (SELECT id, length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(coalesce(text, ''), '[^A-Za-zªºÀ-ÖØ-öø-ɏ]', '', 'g')) AS latin, regexp_extract_all(coalesce(text, ''), '\\p{{L}}+') AS words FROM asked),
    s AS (SELECT *, len(list_filter(words, lambda x: list_contains([{_WORDS}], lower(x)))) / len(words) AS share FROM w),
    p AS (SELECT *, CASE WHEN letters > 0 AND (letters - latin) * 2 > letters THEN FALSE WHEN len(words) < 3 THEN TRUE ELSE share >= 0.3 END AS passed FROM s)"""


@query(f"""WITH asked AS (SELECT doc_id AS id, text FROM documents), {GATE_SQL}
    SELECT id AS doc_id, passed, CASE WHEN NOT passed OR len(words) < 3 THEN NULL WHEN share >= 0.5 THEN 'en' ELSE 'mixed' END AS language FROM p""")
def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.script_gate(F.col("text")).alias("g")).select("doc_id", "g.*")


@query("SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS ascii_letters FROM documents")
def script_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("letters"), F.regexp_count(text, F.lit("[A-Za-z]")).cast("long").alias("ascii_letters"))


@query(f"""WITH {LINES_SQL}, h AS (SELECT page, list_distinct(regexp_extract_all(lower(line), '[a-z]+')) AS w FROM line WHERE line_no = 1), n AS (SELECT a.page AS page, b.page AS other, a.w AS x, b.w AS y FROM h a JOIN h b ON b.page = a.page + 1)
    SELECT page, other, CASE WHEN len(x) + len(y) > 0 THEN round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) ELSE 0 END AS score FROM n""")
def dice_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice overlap of the first lines of neighbouring pages."""
    first = lines(spark, sf_dir).filter("line_no = 1").select("page", F.regexp_extract_all(F.lower("line"), F.lit("([a-z]+)"), F.lit(1)).alias("w"))
    nxt = first.select((F.col("page") - 1).alias("page"), F.col("page").alias("other"), F.col("w").alias("v"))
    return first.join(nxt, "page").select("page", "other", F.round(T.dice(F.col("w"), F.col("v")), 6).alias("score"))


@query("""WITH i AS (SELECT doc_id, lang, source FROM documents), c AS (SELECT doc_id FROM labels) SELECT i.doc_id, i.lang FROM i ANTI JOIN c USING (doc_id)""")
def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows without a chunk."""
    return validate.missing(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("WITH l AS (SELECT conv_id AS src, unnest([conv_id * 7, conv_id * 11]) AS dst FROM conversations WHERE turn = 0) SELECT src, dst FROM l ANTI JOIN documents d ON d.doc_id = l.dst")
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("src"), F.explode(F.array(F.col("conv_id") * 7, F.col("conv_id") * 11)).alias("dst"))
    return validate.missing(links, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("dst")), ["dst"]).select("src", "dst")


@query("SELECT md5(text) AS chunk_id, count(*) AS copies FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicates(table(spark, sf_dir, "documents").select(F.md5("text").alias("chunk_id")), "chunk_id")


@query("""WITH c AS (SELECT doc_id, nullif(CASE WHEN doc_id % 9 <> 0 THEN source ELSE '' END, 'src4') AS citation, text AS content, lang AS jurisdiction FROM documents)
    SELECT doc_id, 'missing citation' AS problem FROM c WHERE coalesce(citation, '') = '' UNION ALL SELECT doc_id, 'missing content' FROM c WHERE coalesce(content, '') = '' UNION ALL SELECT doc_id, 'missing jurisdiction' FROM c WHERE coalesce(jurisdiction, '') = ''
    UNION ALL SELECT doc_id, 'editorial marker ' || m FROM c, (VALUES ('License'), ('###'), ('@')) v(m) WHERE contains(content, m)""")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every missing required field and every editorial marker."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.when(F.col("doc_id") % 9 != 0, F.col("source")).otherwise(""), F.lit("src4")).alias("citation"), F.col("text").alias("content"), F.col("lang").alias("jurisdiction"))
    return validate.integrity(rows, "doc_id", ["citation", "content", "jurisdiction"], "content", ["License", "###", "@"])


@query("""WITH w AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn % 3 = 0 THEN 1 ELSE 0 END AS s, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 1 ELSE 0 END AS e FROM conversations),
    r AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) - coalesce(sum(e) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM w)
    SELECT conv_id, turn, depth > 0 AS not_yet_in_force FROM r""")
def nyif_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from a range's first to its last id, in document order."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    start, stop = ((F.col("role") == "user") & (F.col("turn") % 3 == 0)).cast("int"), ((F.col("role") == "assistant") & (F.col("turn") % 4 == 3)).cast("int")
    depth = F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(F.sum(stop).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (depth > 0).alias("not_yet_in_force"))


@query("""WITH m AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'), v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view')
    SELECT m.event_id AS marker, v.event_id AS note FROM m JOIN v USING (user_id, n)""")
def nth_marker_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th note of a page goes to its n-th marker."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    marker = rows.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("marker"), F.row_number().over(w).alias("n"))
    note = rows.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("note"), F.row_number().over(w).alias("n"))
    return marker.join(note, ["user_id", "n"]).select("marker", "note")


@query("""WITH n AS (SELECT user_id, event_id AS note, CAST(floor(value) AS BIGINT) % 5 AS section FROM events WHERE event_type = 'signup'), c AS (SELECT user_id, event_id AS chunk, CAST(floor(value) AS BIGINT) % 5 AS section FROM events WHERE event_type = 'purchase'),
    p AS (SELECT n.note, c.chunk, n.section = c.section AS m FROM n JOIN c USING (user_id))
    SELECT note, chunk FROM (SELECT *, bool_or(m) OVER (PARTITION BY note) AS a FROM p) WHERE m OR NOT a""")
def notes_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left-over notes go to the chunks of their section on the page, else to every chunk on it."""
    from citeloom.operators.links import narrowed

    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.floor("value") % 5).alias("section"))
    notes = rows.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("note"), F.col("section").alias("wanted"))
    chunk = rows.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("chunk"), "section")
    return narrowed(notes.join(chunk, "user_id"), "note", F.col("wanted") == F.col("section")).select("note", "chunk")


@query(f"""WITH {LINES_SQL}, e AS (SELECT source, page, line_no, n, {SIGNATURE_SQL} AS sig, line FROM line WHERE length(trim(line)) > 0), s AS (
        SELECT source, page, 'top' || (line_no - 1) AS slot, sig FROM e WHERE line_no <= 2 UNION ALL SELECT source, page, 'bot' || (n - line_no), sig FROM e WHERE n - line_no < 2
    ), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source), q AS (
        SELECT DISTINCT s.source, s.sig FROM s JOIN p USING (source) GROUP BY s.source, s.slot, s.sig, p.pages HAVING count(DISTINCT page) >= greatest(2, CAST(floor(0.05 * p.pages) AS BIGINT)))
    SELECT e.page, e.line_no FROM e LEFT JOIN q ON q.source = e.source AND q.sig = e.sig
    WHERE ((e.line_no <= 2 OR e.n - e.line_no < 2) AND q.sig IS NOT NULL) OR ((e.line_no <= 3 OR e.n - e.line_no < 3) AND regexp_full_match(trim(e.line), '[0-9]+'))""")
def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to remove: at an edge with a repeating signature, or a bare number within three lines of one."""
    return validate.furniture_lines(lines(spark, sf_dir), share=0.05)


@query("""WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+')) AS a, list_distinct(regexp_extract_all(replace(text, '1', '2'), '[0-9]+')) AS b FROM documents)
    SELECT doc_id, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS added FROM d""")
def added_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a rewrite that the original does not have (the rewrite here: every 1 is a 2)."""
    def numbers(c: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)))

    added = F.array_except(numbers(F.replace("text", F.lit("1"), F.lit("2"))), numbers(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(added).cast("long").alias("added"))
