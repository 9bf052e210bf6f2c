"""Parser queries: statutes, awards, contents and replies made of the tables' texts, with markers by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import legal
from citeloom.functions import text as T
from citeloom.operators import amendments as A
from citeloom.operators import answers
from citeloom.operators import lines as L
from citeloom.operators import links
from citeloom.operators import sections as S
from citeloom.plans.base import query, table
from citeloom.plans.corpus import lines as page_lines

STATUTE_SQL = r"""raw AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
    st AS (SELECT doc, line_no, CASE WHEN line_no = 1 AND doc % 3 <> 0 THEN '(1) ' || raw
        WHEN (line_no * 7 + doc) % 6 = 0 THEN '(' || (1 + line_no // 3) || CASE WHEN doc % 5 = 0 THEN 'A' ELSE '' END || ') ' || raw
        WHEN (line_no * 7 + doc) % 6 = 1 THEN '(' || chr(CAST(97 + line_no % 3 AS INT)) || ')' || CASE WHEN doc % 2 = 0 THEN ' ' || raw ELSE '' END
        WHEN (line_no * 7 + doc) % 6 = 2 THEN '“' || left(raw, 6) || '” means ' || raw
        WHEN (line_no * 7 + doc) % 6 = 3 THEN raw || ' em-'
        WHEN (line_no * 7 + doc) % 6 = 4 THEN '**' || raw ELSE raw END AS line FROM raw)"""


def statute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, line_no and line: documents' lines with markers of statutes before or after them."""
    rows = page_lines(spark, sf_dir).select(F.col("page").alias("doc"), "line_no", F.col("line").alias("raw"))
    k, raw = (F.col("line_no") * 7 + F.col("doc")) % 6, F.col("raw")
    number = F.concat(F.lit("("), (1 + F.floor(F.col("line_no") / 3)).cast("string"), F.when(F.col("doc") % 5 == 0, "A").otherwise(""), F.lit(") "), raw)
    letter = F.concat(F.lit("("), F.char(97 + F.col("line_no") % 3), F.lit(")"), F.when(F.col("doc") % 2 == 0, F.concat(F.lit(" "), raw)).otherwise(""))
    line = F.when((F.col("line_no") == 1) & (F.col("doc") % 3 != 0), F.concat(F.lit("(1) "), raw)).when(k == 0, number).when(k == 1, letter)
    line = line.when(k == 2, F.concat(F.lit("“"), F.substring(raw, 1, 6), F.lit("” means "), raw)).when(k == 3, F.concat(raw, F.lit(" em-"))).when(k == 4, F.concat(F.lit("**"), raw)).otherwise(raw)
    return rows.select("doc", "line_no", line.alias("line"))


_BLOCK = r'^(?:\((?:[a-z]{1,3}|[ivxl]+|[A-Z])\)|Provided\b|[“"][^”"]{1,80}[”"])'
_BARE = r"(^|\n)\((?:[a-z]{1,3}|[ivxl]+|[A-Z]|\d+[A-Z]?)\)$"


@query(rf"""WITH {STATUTE_SQL}, c AS (SELECT doc, line_no, trim(regexp_replace(regexp_replace(line, '\*+([\w(])', '\1', 'g'), '\s+', ' ', 'g')) AS line FROM st),
    l AS (SELECT doc, list(line ORDER BY line_no) AS ls FROM c WHERE line <> '' GROUP BY doc)
    SELECT doc, md5(list_reduce(ls, lambda acc, x: acc || CASE WHEN regexp_matches(acc, '\p{{L}}-$') THEN '' WHEN regexp_matches(x, '{_BLOCK}') AND NOT regexp_matches(acc, '{_BARE}') THEN chr(10) ELSE ' ' END || x)) AS digest FROM l""")
def statute_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.statute_text(statute_lines(spark, sf_dir), ["doc"]).select("doc", F.md5("text").alias("digest"))


@query(r"""WITH l AS (SELECT doc_id AS doc, list_transform(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i + doc_id) % 5 = 0 THEN '' WHEN (i + doc_id) % 5 = 1 THEN x || '-' ELSE x END), lambda x: trim(x)) AS ls FROM documents),
    p AS (SELECT doc, list_filter(list_transform(string_split_regex(regexp_replace(array_to_string(ls, chr(10)), '(\w-)\n([\p{L}\p{N}])', '\1\2', 'g'), '\n\s*\n'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '') AS ps FROM l)
    SELECT doc, md5(array_to_string(ps, chr(10))) AS digest FROM p WHERE len(ps) > 0""")
def award_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as an award's: every fifth is blank, every fifth ends in a hyphen."""
    rows = page_lines(spark, sf_dir).select(F.col("page").alias("doc"), "line_no", "line")
    k = (F.col("line_no") + F.col("doc")) % 5
    rows = rows.withColumn("line", F.when(k == 0, "").when(k == 1, F.concat("line", F.lit("-"))).otherwise(F.col("line")))
    return L.award_text(rows, ["doc"]).select("doc", F.md5("text").alias("digest"))


@query(r"""WITH t AS (SELECT doc_id, list_transform(range(1, 9), lambda i: substr('wagesday', i, 1)) AS tokens, list_transform(range(1, 8), lambda i: CASE WHEN (i * 3 + doc_id) % 4 = 0 THEN 9.5 ELSE 1.5 + (doc_id % 3) / 4.0 END) AS gaps FROM documents)
    SELECT doc_id, array_to_string(list_transform(tokens, lambda t, i: CASE WHEN i > 1 AND list_max(gaps) > 2 * list_min(gaps) AND gaps[i - 1] > (list_min(gaps) + list_max(gaps)) / 2 THEN ' ' ELSE '' END || t), '') AS words FROM t""")
def spaced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters set apart, with wide gaps by id."""
    tokens = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.substr(F.lit("wagesday"), i, F.lit(1)))
    gaps = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.when((i * 3 + F.col("doc_id")) % 4 == 0, 9.5).otherwise(1.5 + (F.col("doc_id") % 3) / 4.0))
    return table(spark, sf_dir, "documents").select("doc_id", legal.spaced_words(tokens, gaps).alias("words"))


_EDGES = """CASE doc_id % 4 WHEN 0 THEN [left(text, 5), 'Laws ' || doc_id, 'x ACT ' || doc_id] WHEN 1 THEN ['Laws of x', '' || doc_id] WHEN 2 THEN ['a ' || doc_id, (doc_id % 500) || ' Laws ACT 265'] ELSE ['Laws ACT ' || doc_id, 'Laws'] END"""


@query(rf"""WITH e AS (SELECT doc_id, {_EDGES} AS ls FROM documents)
    SELECT doc_id, CAST(nullif(coalesce(list_filter(list_transform(ls, lambda x: regexp_extract(x, '^\s*(\d+)\s*$', 1)), lambda x: x <> '')[1], list_filter(list_transform(ls, lambda x: regexp_extract(x, '^\s*(\d{{1,4}})\s+\D', 1)), lambda x: x <> '')[1],
        list_filter(list_transform(list_filter(ls, lambda x: NOT regexp_matches(x, '\b(?:ACT|Act|CAP|Cap|NO|No)\.?\s*\d+\s*$')), lambda x: regexp_extract(x, '^.*\s(\d{{1,4}})\s*$', 1)), lambda x: x <> '')[1]), '') AS BIGINT) AS page FROM e""")
def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers of edge lines of several forms."""
    own, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    lines = (
        F.when(k == 0, F.array(F.substring("text", 1, 5), F.concat(F.lit("Laws "), own), F.concat(F.lit("x ACT "), own)))
        .when(k == 1, F.array(F.lit("Laws of x"), own))
        .when(k == 2, F.array(F.concat(F.lit("a "), own), F.concat((F.col("doc_id") % 500).cast("string"), F.lit(" Laws ACT 265"))))
        .otherwise(F.array(F.concat(F.lit("Laws ACT "), own), F.lit("Laws")))
    )
    return table(spark, sf_dir, "documents").select("doc_id", legal.printed_page(lines).alias("page"))


@query(r"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    p AS (SELECT doc, n, CASE WHEN n = 4 AND doc % 3 = 0 THEN '—————' WHEN n % 3 = 0 AND n > 2 THEN '*NOTE ' || raw ELSE raw END AS line FROM l),
    s AS (SELECT doc, coalesce(min(n) FILTER (WHERE regexp_matches(trim(line), '^—{5,}$')), min(n) FILTER (WHERE regexp_matches(trim(line), '^\*+\s*NOTE'))) AS start, min(n) FILTER (WHERE regexp_matches(trim(line), '^—{5,}$')) AS rule FROM p GROUP BY doc),
    f AS (SELECT p.doc, list(trim(line) ORDER BY n) AS ls FROM p JOIN s USING (doc) WHERE n >= start AND n IS DISTINCT FROM rule AND trim(line) <> '' GROUP BY p.doc),
    j AS (SELECT doc, string_split(list_reduce(ls, lambda acc, x: acc || CASE WHEN regexp_matches(x, '^\*+\s*NOTE') THEN chr(10) ELSE ' ' END || x), chr(10)) AS ns FROM f)
    SELECT doc, generate_subscripts(ns, 1) AS note, md5(unnest(ns)) AS digest FROM j""")
def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes after a rule of dashes or from the first NOTE on."""
    rows = page_lines(spark, sf_dir).select(F.col("page").alias("doc"), "line_no", "line")
    n = F.col("line_no")
    line = F.when((n == 4) & (F.col("doc") % 3 == 0), "—————").when((n % 3 == 0) & (n > 2), F.concat(F.lit("*NOTE "), "line")).otherwise(F.col("line"))
    return L.notes_apart(rows.withColumn("line", line), ["doc"])[1].select("doc", "note", F.md5("text").alias("digest"))


@query("""SELECT doc_id AS doc, CASE WHEN doc_id % 3 = 0 THEN '(the pay of one whole ' || source || ') / (' || doc_id || ')' ELSE 'pay of ' || source || ' / ' || doc_id END || CASE WHEN doc_id % 2 = 0 THEN ' X twelve' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ';' ELSE '' END AS line
    FROM documents WHERE source IS NOT NULL""")
def fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one line of each document that a fraction over several lines becomes."""
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select(F.col("doc_id").alias("doc"), "source")
    k = F.col("doc")
    upper = F.when(k % 3 == 0, F.concat(F.lit("the pay of one whole "), "source")).otherwise(F.concat(F.lit("pay of "), "source"))
    first = F.when(k % 3 == 0, F.array(F.lit("the  pay of one"), F.concat(F.lit("whole "), "source"))).otherwise(F.array(upper))
    middle = F.when(k % 2 == 0, F.array(F.lit("twelve"), F.lit("X"))).otherwise(F.array().cast("array<string>"))
    last = F.when(k % 5 == 0, F.array(F.lit(";"))).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc", F.posexplode(F.concat(F.array(F.lit("The rate is")), first, middle, F.array(k.cast("string")), last, F.array(F.lit("of that")))).alias("line_no", "line"))
    found = L.fraction_lines(rows, docs.select("doc", upper.alias("upper"), k.cast("string").alias("lower")), ["doc"])
    return found.filter(F.contains("line", F.lit(" / "))).select("doc", "line")


@query(r"""WITH """ + STATUTE_SQL + r""", m AS (SELECT doc, line_no, line, TRY_CAST(regexp_extract(line, '^\s*\((\d+)([A-Z]{0,2})\)\s*', 1) AS BIGINT) AS number, regexp_extract(line, '^\s*\((\d+)([A-Z]{0,2})\)\s*', 2) AS suffix, regexp_replace(line, '^\s*\((\d+)([A-Z]{0,2})\)\s*', '') AS rest,
        last_value(CASE WHEN trim(line) <> '' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lead(line) OVER (PARTITION BY doc ORDER BY line_no) AS next FROM st),
    c AS (SELECT doc, list({'at': line_no, 'number': number, 'suffix': suffix, 'opened': CAST([] AS BIGINT[])} ORDER BY line_no) AS marks FROM m
        WHERE number IS NOT NULL AND (before IS NULL OR regexp_matches(before, '[.;:—)\]]$') OR regexp_matches(coalesce(nullif(trim(rest), ''), trim(next), ''), '^\p{Lu}')) GROUP BY doc),
    o AS (SELECT doc, unnest(list_reduce(list_prepend({'at': CAST(0 AS BIGINT), 'number': CAST(0 AS BIGINT), 'suffix': '', 'opened': CAST([] AS BIGINT[])}, marks), lambda s, x: CASE
        WHEN (len(s.opened) = 0 AND x.at = 1 AND x.number = 1 AND x.suffix = '') OR (len(s.opened) > 0 AND ((x.number = s.number AND x.suffix > s.suffix AND length(x.suffix) >= length(s.suffix)) OR (x.number = s.number + 1 AND x.suffix IN ('', 'A'))))
        THEN {'at': x.at, 'number': x.number, 'suffix': x.suffix, 'opened': list_append(s.opened, x.at)} ELSE s END).opened) AS line_no FROM c)
    SELECT m.doc, m.line_no, last_value(CASE WHEN o.doc IS NOT NULL THEN '(' || number || suffix || ')' END IGNORE NULLS) OVER (PARTITION BY m.doc ORDER BY m.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label, md5(CASE WHEN o.doc IS NOT NULL THEN rest ELSE line END) AS digest
    FROM m LEFT JOIN o ON o.doc = m.doc AND o.line_no = m.line_no""")
def subsections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.subsections(statute_lines(spark, sf_dir), ["doc"]).select("doc", "line_no", "label", F.md5("rest").alias("digest"))


@query(r"""WITH """ + STATUTE_SQL + r""", t AS (SELECT doc, line_no, line, left(concat_ws(' ', regexp_replace(line, '^\s*[“"]([^”"]{1,80})[”"]', ''), coalesce(lead(line) OVER (PARTITION BY doc ORDER BY line_no), '')), 160) AS tail FROM st),
    b AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*[“"]([^”"]{1,80})[”"]') AND regexp_matches(tail, '\b(?:means|includes|has the (?:same )?meaning|shall have the)\b') AND NOT regexp_matches(tail, '^\s*shall be construed')
        THEN trim(regexp_replace(regexp_extract(line, '^\s*[“"]([^”"]{1,80})[”"]', 1), '\s+', ' ', 'g')) END AS own FROM t),
    i AS (SELECT doc, string_agg(line, ' ' ORDER BY line_no) AS flat FROM b GROUP BY doc HAVING count(own) = 0),
    j AS (SELECT doc, CASE WHEN len(regexp_extract_all(flat, '[“"]')) <= 4 THEN nullif(trim(regexp_replace(regexp_extract(flat, '[“"]([^”"]{1,80})[”"]\s*(?:,[^,;]{0,60},\s*)?(?:means|includes)\b', 1), '\s+', ' ', 'g')), '') END AS inl FROM i)
    SELECT b.doc, b.line_no, CASE WHEN inl IS NOT NULL THEN 1 ELSE count(own) OVER w END AS part, coalesce(last_value(own IGNORE NULLS) OVER w, inl) AS term FROM b LEFT JOIN j ON j.doc = b.doc WINDOW w AS (PARTITION BY b.doc ORDER BY b.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.definitions(statute_lines(spark, sf_dir), ["doc"]).select("doc", "line_no", "part", "term")


_REFERRING = "'Under sections ' || (doc_id % 50) || '(2), ' || (doc_id % 7) || 'A and ' || (doc_id % 11) || '; also section ' || (doc_id % 30) || ' of the Trade Unions Act 1959. See subsection ' || (doc_id % 9) || '(1) and regulation ' || (doc_id % 5) || ' of ' || coalesce(source, '') || '. The Wages Order ' || (1900 + doc_id % 100) || ' and the Employment Act 1955 apply, as the Pay and Wages Order 2020 does'"


def _referring(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: (F.col("doc_id") % n).cast("string")
    text = F.concat(F.lit("Under sections "), k(50), F.lit("(2), "), k(7), F.lit("A and "), k(11), F.lit("; also section "), k(30), F.lit(" of the Trade Unions Act 1959. See subsection "), k(9), F.lit("(1) and regulation "), k(5), F.lit(" of "), F.coalesce("source", F.lit("")), F.lit(". The Wages Order "), (1900 + F.col("doc_id") % 100).cast("string"), F.lit(" and the Employment Act 1955 apply, as the Pay and Wages Order 2020 does"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(rf"""WITH t AS (SELECT doc_id, {_REFERRING} AS text FROM documents), r AS (
        SELECT doc_id, list_filter(regexp_extract_all(text, '\b(?:sub)?sections?\s+\d+[A-Z]*(?:\(\d+[A-Z]?\))?(?:\s*(?:,|and|or|to)\s*\d+[A-Z]*(?:\(\d+[A-Z]?\))?)*(?:[^.;]{{0,40}}?\bof the [A-Z][\w’'' ]*(?:Act|Ordinance|Enactment)\b)?'), lambda x: NOT contains(x, 'Act')) AS runs FROM t
    ), f AS (SELECT doc_id, list_transform(list_filter(flatten(list_transform(runs, lambda r: regexp_extract_all(r, '\d+[A-Z]*(?:\(\d+[A-Z]?\))?'))), lambda x: regexp_extract(x, '^\d+[A-Z]*') IN ('1', '2', '3', '4', '5', '6', '7', '8', '2A', '4A', '25', '30')), lambda x: 's. ' || x) AS refs FROM r)
    SELECT doc_id, array_to_string(list_filter(refs, lambda x, i: list_position(refs, x) = i), '|') AS refs FROM f""")
def internal_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(*map(F.lit, "1 2 3 4 5 6 7 8 2A 4A 25 30".split()))
    return _referring(spark, sf_dir).select("doc_id", F.array_join(legal.own_references(F.col("text"), known), "|").alias("refs"))


@query(rf"""WITH t AS (SELECT doc_id, {_REFERRING} AS text FROM documents), n AS (
        SELECT doc_id, list_filter(list_transform(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '\b((?:[A-Z][\w’''()]*\s+)+(?:Act|Ordinance|Enactment|Order|Regulations)\s+\d{{4}}(?:\s*\[(?:Act|Cap\.)\s*[\w.]+\])?)', 1), lambda x: trim(regexp_replace(x, '^(?:[Tt]he|of|under|in)\s+', ''))),
            lambda x: NOT contains(lower(x), 'employment act 1955') AND NOT contains('employment act 1955', lower(x))) AS ns FROM t)
    SELECT doc_id, array_to_string(list_filter(ns, lambda x, i: list_position(ns, x) = i), '|') AS statutes FROM n""")
def other_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _referring(spark, sf_dir).select("doc_id", F.array_join(legal.other_statutes(F.col("text"), F.lit("Employment Act 1955")), "|").alias("statutes"))


_TITLE_FORMS = ("Amendment of section {k}a", "Substitution of sections {k} and {m}.", "Deletion of sections {k}, {m}b", "New section {k}", "Deletion of Chapter XIa", "Amendment of Chapter II", "New Chapter {k}", "New Part IIb.", "Substitution of Schedule", "New First Schedule", "General amendments", "Savings {k}", "Amendment  of   section {m}")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 90).cast("string")
    form = F.get(F.array(*map(F.lit, _TITLE_FORMS)), (F.col("o_orderkey") % len(_TITLE_FORMS)).cast("int"))
    title = F.replace(F.replace(form, F.lit("{k}"), k), F.lit("{m}"), m)
    return table(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"))


_TITLE_SQL = f"replace(replace([{', '.join(repr(f) for f in _TITLE_FORMS)}][o_orderkey % {len(_TITLE_FORMS)} + 1], '{{k}}', o_orderkey::VARCHAR), '{{m}}', (o_orderkey % 90)::VARCHAR)"
_ACTIONS = [("Amendment of sections? (.+)", "amend"), ("Substitution of sections? (.+)", "substitute"), ("Deletion of sections? (.+)", "delete"), ("New sections? (.+)", "insert"), ("Deletion of (Chapter \\w+)", "delete_chapter"), ("Amendment of (Chapter \\w+)", "amend_heading"), ("New (Chapter \\w+)", "insert_chapter"), ("New (Part \\w+)", "insert_part"), ("Substitution of (Schedule)", "substitute_schedule"), ("New .*Schedules?", "insert_schedule"), ("General amendments", "general")]


@query(rf"""WITH t AS (SELECT o_orderkey, regexp_replace(trim(regexp_replace({_TITLE_SQL}, '\s+', ' ', 'g')), '\.+$', '') AS t FROM orders), a AS (
        SELECT o_orderkey, t, CASE {' '.join(f"WHEN regexp_full_match(t, '{f}') THEN '{a}'" for f, a in _ACTIONS)} ELSE 'other' END AS action FROM t)
    SELECT o_orderkey, action, CASE WHEN action IN ('amend', 'substitute', 'delete', 'insert') THEN upper(array_to_string(regexp_extract_all(regexp_extract(t, 'sections? (.+)', 1), '\d+[a-z]*'), ','))
        WHEN action IN ('delete_chapter', 'amend_heading', 'insert_chapter', 'insert_part') THEN regexp_extract(t, '(Chapter|Part) \w+$', 1) || ' ' || upper(regexp_extract(t, '(\w+)$', 1)) WHEN action = 'substitute_schedule' THEN 'SCHEDULE' ELSE '' END AS targets FROM a""")
def amendment_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _titles(spark, sf_dir).withColumn("found", legal.amendment(F.col("title")))
    return found.select("o_orderkey", F.col("found.action").alias("action"), F.array_join("found.targets", ",").alias("targets"))


_PART_FORMS = ("Subsection {k}a({m}) is amended", "(a) by substituting for subsection ({m}) the following", "(b) in the definition of “{m} wages”, by", "(a) by inserting after the definition of “{m}”", "(c) by deleting the definition of “day {k}”;", "(ii) by deleting subsection ({m});", "and {k} in general", "(a) by deleting the words")
_PART_SQL = f"replace(replace([{', '.join(repr(f) for f in _PART_FORMS)}][o_orderkey % {len(_PART_FORMS)} + 1], '{{k}}', o_orderkey::VARCHAR), '{{m}}', (o_orderkey % 90)::VARCHAR)"


@query(rf"""WITH t AS (SELECT o_orderkey, {_PART_SQL} AS t FROM orders), f AS (
        SELECT *, regexp_matches(t, '^(?:Subsection|Paragraph|Subparagraph) (\d+[a-z]*)\((\d+[A-Za-z]?)\)') AS named, regexp_matches(t, '^\(\w+\) (?:by substituting for|by deleting|in) (?:subsection|paragraph) \((\d+[A-Z]?)\)') AS within, regexp_matches(t, 'by inserting after the (?:deleted )?definition of') AS adds FROM t)
    SELECT o_orderkey, CASE WHEN named THEN upper(regexp_extract(t, '^\w+ (\d+[a-z]*)', 1)) END AS section, CASE WHEN named OR within THEN '(' || regexp_extract(t, '\((\d+[A-Za-z]?)\)', 1) || ')' END AS subsection,
        CASE WHEN NOT named AND NOT within AND NOT adds THEN nullif(regexp_extract(t, '(?:in|for|deleting) the definition of “([^”]+)”', 1), '') END AS term, adds, regexp_matches(t, '^\(\w+\) by deleting (?:the definition of|subsection|paragraph \()') AS removes FROM f""")
def amendment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 90).cast("string")
    line = F.get(F.array(*(F.replace(F.replace(F.lit(f), F.lit("{k}"), k), F.lit("{m}"), m) for f in _PART_FORMS)), (F.col("o_orderkey") % len(_PART_FORMS)).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    rows = rows.withColumns({"t": legal.amendment_target(F.col("line")), "adds": legal.inserts_definition(F.col("line")), "removes": legal.removes_whole(F.col("line"))})
    return rows.select("o_orderkey", "t.section", "t.subsection", "t.term", "adds", "removes")


def contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, line_no, line: for each source a contents list, a line for each of its documents."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select(F.col("source").alias("doc"), n.alias("line_no"), "doc_id")
    k, own = F.col("line_no") % 12, F.col("line_no").cast("string")
    after = lambda d: (F.col("line_no") + d).cast("string")
    line = (
        F.when(F.col("line_no") == 1, "ARRANGEMENT OF SECTIONS").when(k == 1, F.concat(F.lit("PART "), own)).when(k == 5, F.concat(F.lit("CHAPTER "), own, F.lit(" — Wages")))
        .when(k == 6, "Section").when(k == 7, F.concat(own, F.lit("-"), after(1), F.lit(". (Deleted by Act A"), F.col("doc_id").cast("string"), F.lit(")"))).when(k == 8, "and more  text")
        .when(k == 9, F.concat(F.lit("(NOT YET IN FORCE) (Section "), after(1), F.lit(" — "), after(2), F.lit(")"))).when(k == 0, "FIRST SCHEDULE")
        .otherwise(F.concat(own, F.when(F.col("doc_id") % 3 == 0, "a").otherwise(""), F.lit(". Title of "), F.col("doc_id").cast("string")))
    )
    return rows.select("doc", "line_no", line.alias("line"))


CONTENTS_SQL = """cl AS (SELECT source AS doc, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL)"""


@query(f"""WITH {CONTENTS_SQL}, i AS (
        SELECT doc, n, doc_id, CASE WHEN n % 12 = 0 THEN ['FIRST SCHEDULE'] WHEN n % 12 = 7 THEN [n::VARCHAR, (n + 1)::VARCHAR] WHEN n % 12 IN (2, 3, 4, 10, 11) THEN [n || CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE '' END] END AS ids,
            max(CASE WHEN n % 12 = 1 AND n > 1 THEN n END) OVER w AS part, max(CASE WHEN n % 12 = 5 THEN n END) OVER w AS chapter, lead(n % 12) OVER (PARTITION BY doc ORDER BY n) = 8 AS more,
            max(CASE WHEN n % 12 = 9 THEN n END) OVER w AS pending FROM cl WINDOW w AS (PARTITION BY doc ORDER BY n)
    ), e AS (
        SELECT *, max(CASE WHEN list_contains(ids, (pending + 2)::VARCHAR) THEN pending END) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended,
            CASE WHEN n % 12 = 7 THEN '(Deleted by Act A' || doc_id || ')' ELSE 'Title of ' || doc_id END || CASE WHEN more THEN ' and more text' ELSE '' END AS title FROM i
    ), r AS (SELECT *, unnest(ids) AS section FROM e WHERE ids IS NOT NULL)
    SELECT doc, section, CASE WHEN n % 12 = 0 OR (n % 12 = 7 AND NOT coalesce(more, false)) THEN NULL ELSE title END AS title, CASE WHEN part IS NOT NULL THEN 'Part ' || part END AS part, CASE WHEN chapter > coalesce(part, 0) THEN 'Chapter ' || chapter END AS chapter,
        CASE WHEN chapter > coalesce(part, 0) THEN 'Wages' END AS chapter_title, CASE WHEN n % 12 = 7 AND NOT coalesce(more, false) THEN 'deleted' ELSE 'listed' END AS status, CASE WHEN n % 12 = 7 AND NOT coalesce(more, false) THEN 'Act A' || doc_id END AS deleted_by,
        n % 12 <> 0 AND pending IS NOT NULL AND coalesce(ended, -1) < pending AS not_yet_in_force FROM r""")
def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.contents(contents_lines(spark, sf_dir), ["doc"]).select("doc", "section", "title", "part", "chapter", "chapter_title", "status", "deleted_by", "not_yet_in_force")


@query("""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    s AS (SELECT doc, list({'words': CAST(len(regexp_extract_all(line, '[^\\s]+')) AS DOUBLE), 'numbered': n % 4 = 0, 'begins': CAST([] AS BIGINT[]), 'at': n} ORDER BY n) AS ls FROM l GROUP BY doc),
    b AS (SELECT doc, list_reduce(list_prepend({'words': CAST(0 AS DOUBLE), 'numbered': false, 'begins': CAST([] AS BIGINT[]), 'at': CAST(0 AS BIGINT)}, ls), lambda s, x: CASE WHEN len(s.begins) = 0 OR (x.numbered AND s.words >= 40) OR s.words >= 1.3 * 40
        THEN {'words': x.words + CASE WHEN x.numbered THEN 1 ELSE 0 END, 'numbered': x.numbered, 'begins': list_append(s.begins, x.at), 'at': x.at} ELSE {'words': s.words + x.words + CASE WHEN x.numbered THEN 1 ELSE 0 END, 'numbered': x.numbered, 'begins': s.begins, 'at': x.at} END).begins AS begins FROM s)
    SELECT l.doc, l.n AS line_no, CAST(len(list_filter(b.begins, lambda k: k <= l.n)) AS BIGINT) AS run FROM l JOIN b USING (doc)""")
def word_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 40 words; every fourth line is a numbered row."""
    rows = page_lines(spark, sf_dir).select(F.col("page").alias("doc"), "line_no", "line")
    rows = rows.withColumn("line", F.when(F.col("line_no") % 4 == 0, F.concat(F.col("line_no").cast("string"), F.lit(". "), "line")).otherwise(F.regexp_replace("line", r"^\s*\d+[A-Z]?\.", "x")))
    return L.word_budget(rows, ["doc"], 40).select("doc", "line_no", "run")


def award_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, line_no, page, line: each turn a numbered paragraph in lower case, some with a heading at the end; then the signature."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("x "), F.trim(F.lower(F.regexp_replace(F.replace("text", F.lit("\n"), F.lit(" ")), "[^A-Za-z]+", " "))), F.lit(".")).alias("words"))
    head = F.when(F.col("turn") % 3 == 1, F.array(F.lit(""), F.lit("BACKGROUND"), F.concat(F.lit("OF FACTS "), F.regexp_replace(F.col("turn").cast("string"), r"\d+", "HERE")))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), "words"), F.lit("[99] is not next")), F.array(F.lit("it ends here.")), head)
    every = rows.select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("page"), F.posexplode(lines).alias("at", "line"))
    ends = rows.groupBy(F.col("conv_id").alias("doc")).agg(F.max("turn").cast("int").alias("page")).select("doc", "page", F.lit(9).alias("at"), F.lit("Dated this day").alias("line"))
    return every.unionByName(ends).withColumn("line_no", F.col("page") * 10 + F.col("at"))


@query("""WITH w AS (SELECT conv_id AS doc, CAST(turn AS INT) AS turn, 'x ' || trim(lower(regexp_replace(replace(text, chr(10), ' '), '[^A-Za-z]+', ' ', 'g'))) || '. [99] is not next it ends here.' AS text FROM conversations)
    SELECT doc, turn + 1 AS number, md5(text) AS digest, turn AS first_page, turn AS last_page, CASE WHEN turn > 1 THEN 'BACKGROUND OF FACTS HERE' END AS heading FROM w""")
def award_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.award_paragraphs(award_lines(spark, sf_dir), ["doc"], "bracket")
    return found.select("doc", "number", F.md5("text").alias("digest"), "first_page", "last_page", "heading")


@query("""WITH p AS (SELECT conv_id AS doc, CAST(turn AS INT) AS number, CASE WHEN turn % 4 = 3 THEN ' ' WHEN turn % 5 = 4 THEN 'Dated this day' ELSE text END AS text FROM conversations WHERE turn > 0),
    g AS (SELECT doc, max(number) AS last, count(*) FILTER (WHERE number BETWEEN 2 AND 4) AS kept, list(number ORDER BY number) AS ns FROM p GROUP BY doc)
    SELECT doc, 'paragraphs not consecutive' AS problem FROM g WHERE ns <> range(1, last + 1) UNION ALL SELECT doc, 'range 2..4 outside 1..' || last FROM g WHERE last < 4
    UNION ALL SELECT doc, 'only ' || kept || ' reasoning paragraphs' FROM g WHERE kept < 3 UNION ALL SELECT doc, 'para ' || number || ' is empty' FROM p WHERE trim(text) = '' UNION ALL SELECT doc, 'para ' || number || ' contains signature text' FROM p WHERE regexp_matches(text, '(?i)(HANDED DOWN|DIBERIKAN|DATED THIS|DATED THE)\\b')""")
def award_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    text = F.when(turn % 4 == 3, " ").when(turn % 5 == 4, "Dated this day").otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").filter("turn > 0").select(F.col("conv_id").alias("doc"), turn.cast("int").alias("number"), text.alias("text"))
    return L.award_problems(rows, ["doc"], F.array(F.struct(F.lit(2).alias("first"), F.lit(4).alias("last"))), least=3).select("doc", "problem")


def schedule_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, page, y, side, text: for each order a table, on the left a row and a nested marker for each line item, on the right two cells near the marker."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), "l_linenumber", "l_partkey", "l_suppkey")
    n = F.row_number().over(Window.partitionBy("t").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    items = items.withColumn("n", n)
    y, text = F.col("n") * 100.0, lambda *x: F.concat(*(c if isinstance(c, Column) else F.lit(c) for c in x))
    n_, part, supp = (F.col(c).cast("string") for c in ("n", "l_partkey", "l_suppkey"))
    cell = lambda dy, side, what: F.struct((y + dy).alias("y"), F.lit(side).alias("side"), what.alias("text"))
    cells = F.array(cell(0, "left", text(n_, ". Work  ", part)), cell(20, "left", text("(1) by ", supp)), cell(30, "left", F.lit("(a) not this kind")), cell(16, "right", text("sections ", part)), cell(26, "right", text("and ", supp)), cell(70, "right", text("part ", n_)))
    return items.select("t", F.lit(0).alias("page"), F.explode(cells).alias("c")).select("t", "page", "c.y", "c.side", "c.text")


_ITEMS = "i AS (SELECT l_orderkey AS t, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)"


@query(f"WITH {_ITEMS} SELECT t, n AS row, n::VARCHAR AS id, 'Work ' || p || ' (1) by ' || s || chr(10) || '(a) not this kind' AS text FROM i")
def schedule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table_rows(schedule_cells(spark, sf_dir), ["t"])[0].select("t", "row", "id", "text")


@query(f"WITH {_ITEMS} SELECT t, n AS row, '(1)' AS applies_to, 'sections ' || p || ' and ' || s || ' part ' || n AS provisions FROM i")
def schedule_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table_rows(schedule_cells(spark, sf_dir), ["t"])[1].select("t", "row", "applies_to", "provisions")


@query(r"SELECT doc_id, regexp_replace(left(text, 20) || '–' || chr(65533) || chr(57345) || text, '[\x{2013}\x{FFFD}\x{E000}-\x{F8FF}]', '—', 'g') AS text FROM documents")
def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.substring("text", 1, 20), F.lit("–�"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalised_glyphs(raw).alias("text"))


_REPLY = "'Leave is ' || item_id || ' days [3]. Other words stand here without any source at all. Both [ ' || (item_id % 7) || ', 9] and [4–2], or [' || (item_id % 5) || ']. See section ' || item_id || 'A(1) of the Employment Act 1955.'"
_MARK = r"\s*\[\s*\d+(?:\s*[-–,]\s*\d+)*\s*\]"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("item_id")
    text = F.concat(F.lit("Leave is "), n.cast("string"), F.lit(" days [3]. Other words stand here without any source at all. Both [ "), (n % 7).cast("string"), F.lit(", 9] and [4–2], or ["), (n % 5).cast("string"), F.lit("]. See section "), n.cast("string"), F.lit("A(1) of the Employment Act 1955."))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"), (n % 6).alias("blocks"))


@query(rf"""WITH r AS (SELECT item_id AS query_id, {_REPLY} AS text, item_id % 6 AS blocks, [[3], [item_id % 7, 9], [2, 3, 4], [item_id % 5]] AS groups FROM benchmark),
    v AS (SELECT *, list_filter(flatten(groups), lambda n: n BETWEEN 1 AND blocks) AS ok, list_filter(flatten(groups), lambda n: NOT n BETWEEN 1 AND blocks) AS no, string_split_regex(text, '{_MARK}') AS parts FROM r),
    d AS (SELECT *, list_filter(ok, lambda n, i: list_position(ok, n) = i) AS cited, list_filter(no, lambda n, i: list_position(no, n) = i) AS invalid FROM v),
    a AS (SELECT *, array_to_string(list_transform(parts, lambda p, i: p || CASE WHEN i <= 4 AND len(list_filter(groups[i], lambda n: n BETWEEN 1 AND blocks)) > 0 THEN ' ' || array_to_string(list_transform(list_filter(groups[i], lambda n: n BETWEEN 1 AND blocks), lambda n: '[' || list_position(cited, n) || ']'), '') ELSE '' END), '') AS answer FROM d)
    SELECT query_id, answer, array_to_string(cited, ',') AS cited, array_to_string(invalid, ',') AS invalid, 2 AS uncited, 'section ' || query_id || 'A(1)|Employment Act 1955' AS mentions FROM a""")
def resolved_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _replies(spark, sf_dir).withColumn("r", answers.resolved(F.col("text"), F.col("blocks")))
    return found.select("query_id", "r.answer", F.array_join(F.transform("r.cited", lambda n: n.cast("string")), ",").alias("cited"), F.array_join(F.transform("r.invalid", lambda n: n.cast("string")), ",").alias("invalid"), "r.uncited", F.array_join("r.mentions", "|").alias("mentions"))


@query("""WITH r AS (SELECT item_id AS query_id, item_id % 4 AS k, item_id % 3 + 1 AS blocks FROM benchmark)
    SELECT query_id, CASE k WHEN 0 THEN 'abstained' WHEN 1 THEN 'insufficient_context' ELSE 'answered' END AS status, CASE k WHEN 0 THEN 'Please ask in English.' WHEN 1 THEN NULL ELSE 'Yes ' || query_id || ' [1].' END AS answer, CASE WHEN k = 3 THEN 'only the east.' END AS limits, CASE WHEN k > 1 THEN '1' ELSE '' END AS cited, k = 3 AS truncated FROM r""")
def assembled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of all kinds: abstained, not enough context, answered, with limits."""
    k, own = F.col("item_id") % 4, F.col("item_id").cast("string")
    reply = F.when(k == 1, "<think>hm\nhm</think>INSUFFICIENT_CONTEXT").when(k == 2, F.concat(F.lit("<think>x</think> Yes "), own, F.lit(" [1]."))).when(k == 3, F.concat(F.lit("Yes "), own, F.lit(" [1].\n**LIMITS: only the east [1].\n")))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(k == 0, "language").alias("reason"), F.when(k == 0, "Please ask in English.").alias("notice"), reply.alias("reply"), F.when(k == 3, "length").otherwise("stop").alias("finish"), (F.col("item_id") % 3 + 1).alias("blocks"))
    return answers.assemble(rows).select("query_id", "status", "answer", "limits", F.array_join(F.transform("cited", lambda n: n.cast("string")), ",").alias("cited"), "truncated")


@query("""WITH h AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'DECISION:' WHEN 1 THEN 'Facts of ' || coalesce(source, 'x') WHEN 2 THEN '(a)' WHEN 3 THEN 'Ali v Abu' WHEN 4 THEN 'the end' WHEN 5 THEN 'Costs' WHEN 6 THEN 'Section 4. More' ELSE 'Of the' END AS t FROM documents)
    SELECT doc_id, doc_id % 8 IN (0, 1, 2, 5, 7) AS part, doc_id % 8 IN (0, 1, 6) OR t IN ('Ali v Abu', 'the end') AS heading FROM h""")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that can be part of a heading, and texts that are one."""
    k = F.col("doc_id") % 8
    t = F.when(k == 0, "DECISION:").when(k == 1, F.concat(F.lit("Facts of "), F.coalesce("source", F.lit("x")))).when(k == 2, "(a)").when(k == 3, "Ali v Abu").when(k == 4, "the end").when(k == 5, "Costs").when(k == 6, "Section 4. More").otherwise("Of the")
    return table(spark, sf_dir, "documents").select("doc_id", legal.heading_part(t).alias("part"), legal.whole_heading(t).alias("heading"))


def _statutes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines and contents of a statute for each source, a section for each of its documents.

    Sections are placeholders, subsections, definitions or plain by their number;
    every seventh has no title, some contents lines have no section, and some
    placeholders are a range that holds a lettered section too.
    """
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select(F.col("source").alias("doc"), "doc_id", n.cast("long").alias("n"))
    n, own, number = F.col("n"), F.col("doc_id").cast("string"), F.col("n").cast("string")
    wide, none = (n % 4 == 0) & (n % 3 == 0), F.array().cast("array<string>")
    title = F.when(n % 7 != 0, F.concat(F.lit("Pay of kind "), own))
    parts = lambda *x: F.array(*(F.concat(*(c if isinstance(c, Column) else F.lit(c) for c in line)) if isinstance(line, tuple) else F.lit(line) for line in x))
    text = (
        F.when(wide, parts((number, "-", number, ". (Deleted by Act A", own, ").")))
        .when(n % 4 == 0, parts((number, ". (Deleted by Act A", own, ").")))
        .when(n % 4 == 1, parts((number, ". (1) Every word is here ", own, "."), "(2) More of it;", "(a) one thing"))
        .when(n % 4 == 2, parts((number, ". In this Act—"), "“wages” means", ("money of kind ", own, "."), "“day” includes a night."))
        .otherwise(parts((number, ". Plain text under section ", (n - 1).cast("string"), "."), "[Am. Act A1.]", "goes on here."))
    )
    heading = F.when(n % 10 == 1, parts(("PART ", number))).otherwise(none)
    every = F.concat(heading, F.when(title.isNotNull(), F.array(title)).otherwise(none), text)
    lines = rows.select("doc", "n", F.posexplode(every).alias("k", "line")).select("doc", (F.col("n") * 10 + F.col("k")).alias("line_no"), "line")
    entry = lambda ord_, section, title: F.struct(ord_.alias("ord"), section.alias("section"), title.alias("title"))
    more = F.when(wide, F.array(entry(n * 2 + 1, F.concat(number, F.lit("A")), F.lit(None).cast("string")))).when(n % 9 == 0, F.array(entry(n * 2 + 1, F.concat(number, F.lit("Z")), F.lit("Lost"))))
    entries = F.concat(F.array(entry(n * 2, number, title)), F.coalesce(more, F.array().cast("array<struct<ord:bigint,section:string,title:string>>")))
    contents = rows.select("doc", "n", F.explode(entries).alias("e")).select("doc", "e.ord", "e.section", "e.title", F.lit("listed").alias("status"), F.lit(None).cast("string").alias("deleted_by"), (F.col("n") > 20).alias("later"))
    return lines, contents


@query("""WITH r AS (SELECT source AS doc, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL),
    t AS (SELECT *, CASE WHEN n % 7 <> 0 THEN 'Pay of kind ' || doc_id END AS title, CASE WHEN n > 20 THEN 'not_yet_in_force' ELSE 'in_force' END AS own FROM r),
    c AS (
        SELECT doc, n::VARCHAR AS section, NULL AS label, 'provision' AS kind, CASE WHEN n % 3 = 0 THEN 'range_placeholder' ELSE 'placeholder' END AS rule, 'deleted' AS status, 'Act A' || doc_id AS deleted_by, NULL AS term, NULL AS scope, title, '(Deleted by Act A' || doc_id || ').' AS text FROM t WHERE n % 4 = 0
        UNION ALL SELECT doc, n || 'A', NULL, 'provision', 'range_placeholder', 'deleted', 'Act A' || doc_id, NULL, NULL, title, '(Deleted by Act A' || doc_id || ').' FROM t WHERE n % 12 = 0
        UNION ALL SELECT doc, n::VARCHAR, '(1)', 'provision', 'subsection', own, NULL, NULL, NULL, title, 'Every word is here ' || doc_id || '.' FROM t WHERE n % 4 = 1
        UNION ALL SELECT doc, n::VARCHAR, '(2)', 'provision', 'subsection', own, NULL, NULL, NULL, title, 'More of it;' || chr(10) || '(a) one thing' FROM t WHERE n % 4 = 1
        UNION ALL SELECT doc, n::VARCHAR, NULL, 'definition', 'definition', own, NULL, 'wages', 'In this Act—', title, '“wages” means money of kind ' || doc_id || '.' FROM t WHERE n % 4 = 2
        UNION ALL SELECT doc, n::VARCHAR, NULL, 'definition', 'definition', own, NULL, 'day', 'In this Act—', title, '“day” includes a night.' FROM t WHERE n % 4 = 2
        UNION ALL SELECT doc, n::VARCHAR, NULL, 'provision', 'section_undivided', own, NULL, NULL, NULL, title, 'Plain text under section ' || (n - 1) || '. goes on here.' FROM t WHERE n % 4 = 3
    ) SELECT *, CASE WHEN contains(text, 'under section') AND NOT contains(text, 'section 0.') THEN 's. ' || (section::INT - 1) ELSE '' END AS internal FROM c""")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, expected = _statutes(spark, sf_dir)
    found = S.references(S.chunks(lines, expected, ["doc"]), expected, ["doc"], F.lit("Wages Act 1900"))
    return found.select("doc", "section", "label", "kind", "rule", "status", "deleted_by", "term", "scope", "title", "text", F.array_join("internal", ",").alias("internal"))


@query("""WITH r AS (SELECT source AS doc, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL)
    SELECT doc, count(*) + count(*) FILTER (WHERE n % 12 = 0 OR n % 9 = 0) AS expected, count(*) + count(*) FILTER (WHERE n % 12 = 0) AS located, coalesce(string_agg(n || 'Z', ',' ORDER BY n) FILTER (WHERE n % 9 = 0 AND n % 12 <> 0), '') AS missing FROM r GROUP BY doc""")
def section_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.report(*_statutes(spark, sf_dir), ["doc"])
    return found.select("doc", "expected", "located", F.array_join("missing", ",").alias("missing"))


def _amending(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of an Act (from documents) and amending parts (from orders), by titles and first lines."""
    k = F.col("doc_id") % 90
    principal = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.when(k == 89, "SCHEDULE").otherwise(k.cast("string")).alias("section"), F.concat(F.lit("("), (F.col("doc_id") % 4).cast("string"), F.lit(")")).alias("subsection"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(k.cast("string"), F.lit(" wages"))).alias("term"), F.when(k < 20, "Chapter XIA").alias("chapter"),
    )
    n = F.col("o_orderkey").cast("string")
    m = (F.col("o_orderkey") % 90).cast("string")
    form = F.get(F.array(*map(F.lit, _LINK_FORMS)), (F.floor(F.col("o_orderkey") / 13) % len(_LINK_FORMS)).cast("int"))
    line = F.replace(F.replace(form, F.lit("{k}"), n), F.lit("{m}"), m)
    titles = _titles(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey")  # few files, but much to do for a row
    rows = titles.withColumns({"line": line, "a": legal.amendment(F.col("title"))}).withColumn("t", legal.amendment_target(F.col("line")))
    return principal, rows.select(F.col("o_orderkey").alias("src_id"), F.col("o_orderkey").alias("ord"), "a.action", "a.targets", "t.section", "t.subsection", "t.term", legal.inserts_definition(F.col("line")).alias("inserts"), legal.removes_whole(F.col("line")).alias("removes"))


_LINK_FORMS = ("Subsection {m}(2) is amended", "(a) by deleting subsection (1);", "(b) in the definition of “{m} wages”, by", "(a) by inserting after the definition of “day”", "(c) by deleting the definition of “{m} wages”;", "in general")
_LINKS_SQL = rf"""t AS (SELECT o_orderkey AS src, regexp_replace(trim(regexp_replace({_TITLE_SQL}, '\s+', ' ', 'g')), '\.+$', '') AS t, (o_orderkey // 13) % 6 AS f, (o_orderkey % 90)::VARCHAR AS m FROM orders),
    a AS (SELECT *, CASE {' '.join(f"WHEN regexp_full_match(t, '{f}') THEN '{a}'" for f, a in _ACTIONS)} ELSE 'other' END AS action FROM t WHERE f <> 3),
    g AS (SELECT src, f, m, CASE WHEN action = 'delete' OR f IN (1, 4) THEN 'delete' ELSE action END AS act, CASE WHEN action IN ('amend', 'substitute', 'delete') THEN CASE WHEN f = 0 THEN [m] ELSE list_transform(regexp_extract_all(regexp_extract(t, 'sections? (.+)', 1), '\d+[a-z]*'), lambda x: upper(x)) END
            WHEN action = 'substitute_schedule' THEN ['SCHEDULE'] END AS secs, action, CASE WHEN action = 'delete_chapter' THEN 'Chapter XIA' END AS chap FROM a WHERE action IN ('amend', 'substitute', 'delete', 'delete_chapter', 'substitute_schedule')),
    c AS (SELECT doc_id AS dst, CASE WHEN doc_id % 90 = 89 THEN 'SCHEDULE' ELSE (doc_id % 90)::VARCHAR END AS sec, doc_id % 4 AS sub, CASE WHEN doc_id % 3 = 0 THEN doc_id % 90 END AS term, CASE WHEN doc_id % 90 < 20 THEN 'Chapter XIA' END AS chap FROM documents),
    p AS (SELECT g.src, c.dst, g.act, coalesce(CASE f WHEN 0 THEN c.sub = 2 WHEN 1 THEN c.sub = 1 WHEN 2 THEN c.term::VARCHAR = g.m WHEN 4 THEN c.term::VARCHAR = g.m END, false) AS hit FROM g JOIN c ON list_contains(g.secs, c.sec) OR g.chap = c.chap),
    e AS (SELECT src, dst, act FROM (SELECT *, bool_or(hit) OVER (PARTITION BY src) AS matched FROM p) WHERE hit OR NOT matched)"""


@query(f"WITH {_LINKS_SQL} SELECT src AS src_id, dst AS dst_id, act AS action FROM e")
def amendment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.from_amendments(*_amending(spark, sf_dir))[0].select("src_id", "dst_id", "action")


@query(f"WITH {_LINKS_SQL} SELECT src AS src_id FROM g WHERE src NOT IN (SELECT src FROM p)")
def unresolved_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.unresolved(*_amending(spark, sf_dir))


@query(f"""WITH {_LINKS_SQL} SELECT dst AS chunk_id, CASE WHEN bool_or(act IN ('delete', 'delete_chapter')) THEN 'deleted' ELSE 'superseded' END AS status, min(src) FILTER (WHERE act IN ('delete', 'delete_chapter')) AS deleted_by FROM e GROUP BY dst""")
def amended_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.amended(*_amending(spark, sf_dir))


@query("""WITH r AS (SELECT source AS doc, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS n FROM documents WHERE source IS NOT NULL)
    SELECT doc, n AS number, 'Amendment of section ' || n AS title, 'amend' AS action, n::VARCHAR AS targets, part, label, subsection, CASE WHEN part = 2 THEN 'kind ' || doc_id END AS term, part = 2 AS removes, '' AS new_section, text FROM (
        SELECT *, 1 AS part, '(a)(i)' AS label, '(1)' AS subsection, 'Section ' || n || ' is amended—' || chr(10) || '(a) in subsection (1)—' || chr(10) || '(i) by inserting the words of kind ' || doc_id || ' and more of the same sort;' AS text FROM r WHERE n % 3 = 0
        UNION ALL SELECT *, 2, '(a)(ii)', '(1)', '(ii) by deleting the definition of “kind ' || doc_id || '” as it stands;' FROM r WHERE n % 3 = 0
        UNION ALL SELECT *, 3, '(b)', '(6)', '(b) in subsection (6), by words.' FROM r WHERE n % 3 = 0)
    UNION ALL SELECT doc, n, 'New section ' || n || 'a', 'insert', n || 'A', 1, NULL, NULL, NULL, false, n || 'A', 'It is inserted for ' || doc_id || '.' FROM r WHERE n % 3 = 1
    UNION ALL SELECT doc, n, 'General amendments', 'general', '', 1, NULL, NULL, NULL, false, '', 'The words ' || doc_id || ' go.' FROM r WHERE n % 3 = 2""")
def amending_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an amending Act for each source: paragraphs of long sections, lead-ins, and what each names."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    rows = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select(F.col("source").alias("doc"), "doc_id", n.alias("n"))
    number, own, k = F.col("n").cast("string"), F.col("doc_id").cast("string"), F.col("n") % 3
    long = F.array(
        F.concat(F.lit("Amendment of section "), number), F.concat(number, F.lit(". Section "), number, F.lit(" is amended—")), F.lit("(a) in subsection (1)—"),
        F.concat(F.lit("(i) by inserting the words of kind "), own, F.lit(" and more of the same sort;")), F.concat(F.lit("(ii) by deleting the definition of “kind "), own, F.lit("” as it stands;")), F.lit("(b) in subsection (6), by words."),
    )
    new = F.array(F.concat(F.lit("New section "), number, F.lit("a")), F.concat(number, F.lit(". It is inserted for "), own, F.lit(".")))
    general = F.array(F.lit("General amendments"), F.concat(number, F.lit(". The words "), own, F.lit(" go.")))
    lines = rows.select("doc", "n", F.posexplode(F.when(k == 0, long).when(k == 1, new).otherwise(general)).alias("at", "line")).select("doc", (F.col("n") * 10 + F.col("at")).alias("line_no"), "line")
    found = A.parts(lines, ["doc"], 20)
    return found.select("doc", "number", "title", "action", F.array_join("targets", ",").alias("targets"), "part", "label", "subsection", "term", "removes", F.array_join("new_section", ",").alias("new_section"), "text")
