"""Model, prompt, answer-layout and report queries, with deterministic models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import FUNCTION_WORDS
from citeloom.operators import answers, models
from citeloom.plans.base import query, table
from citeloom.plans.ranking import TOKENS_SQL, bm25_list, questions, search_index, top_sql
from citeloom.sources import tables
from citeloom.sources.scratch import scratch


@query("""WITH w AS (SELECT item_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda t: md5(t)[1]) AS hs FROM benchmark),
    c AS (SELECT item_id, list_transform(range(16), lambda i: CAST(len(list_filter(hs, lambda h: h = '0123456789abcdef'[i + 1])) AS DOUBLE)) AS v FROM w),
    n AS (SELECT item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM c)
    SELECT item_id AS query_id, round(list_sum(list_transform(v, lambda x, i: i * x)) / norm, 6) AS weighed FROM n""")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of the offline encoder, as a sum weighed by the dimension."""
    rows = questions(spark, sf_dir).select("query_id", models.embedded(F.col("text")).alias("v"))
    return rows.select("query_id", F.round(F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("weighed"))


def _long(word: str) -> float:
    return 0.6 if len(word) > 9 else 0.1


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS ws FROM documents)
    SELECT doc_id, len(ws) AS n_words, len(list_filter(ws, lambda x: length(x) > 9 OR list_contains([{', '.join(repr(w) for w in FUNCTION_WORDS)}], x))) AS n_english FROM w""")
def detected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the list, or that a detector is confident of (here: long ones)."""
    return models.detected_words(table(spark, sf_dir, "documents"), "doc_id", "text", list(FUNCTION_WORDS), lambda: _long)


def _client():
    tried: dict[str, int] = {}

    def call(prompt: str) -> tuple[str, str]:
        tried[prompt] = tried.get(prompt, 0) + 1
        n = int(prompt.rsplit(" ", 1)[1])
        if n % 4 == 1 and tried[prompt] <= n % 7:
            raise models.Transient("busy")
        return f"Rewritten question: \"How many days of leave are there for worker {n}?\"", "stop"

    return call


@query("""SELECT item_id AS query_id, CASE WHEN item_id % 4 = 1 AND item_id % 7 > 3 THEN NULL ELSE 'How many days of leave are there for worker ' || item_id || '?' END AS rewrite, CASE WHEN item_id % 4 = 1 AND item_id % 7 > 3 THEN 'failed after 4 attempts: busy' END AS error,
    CASE WHEN (item_id % 4 = 1 AND item_id % 7 > 3) OR item_id % 3 = 0 THEN '' ELSE item_id::VARCHAR END AS added FROM benchmark""")
def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites by a client that is busy at first, and the numbers that they add to the question."""
    asked = questions(spark, sf_dir).select("query_id", F.concat(F.lit("rewrite "), F.col("query_id").cast("string")).alias("prompt"))
    found = models.ask(asked, _client, wait=_no_wait)
    original = F.when(F.col("query_id") % 3 == 0, F.col("query_id").cast("string")).otherwise("two days")
    sentence = models.clean_rewrite(F.col("reply"))
    return found.select("query_id", sentence.alias("rewrite"), "error", F.array_join(models.added_numbers(original, sentence), ",").alias("added"))


def _no_wait(_: float) -> None:
    return None




@query("""WITH k AS (SELECT item_id AS query_id, item_id % 3 + 1 AS n FROM benchmark)
    SELECT query_id, u.line, u.block, u.kind, u.statements FROM k, (VALUES
        (0, 1, 'heading', 1, 'Rest:'), (0, 1, 'heading', 2, 'Rest:'), (0, 1, 'heading', 3, 'Rest:'),
        (1, 2, 'bullet', 1, 'Eight days:1|[2]. And more [9] of:1'), (1, 2, 'bullet', 2, 'Eight days.:1,2| And more [9] of:1'), (1, 2, 'bullet', 3, 'Eight days.:1,2| And more [9] of:1'),
        (2, 2, 'bullet', 1, 'Two:'), (2, 2, 'bullet', 2, 'Two:'), (2, 2, 'bullet', 3, 'Two:'),
        (3, 3, 'ordered', 1, 'First [2], then:'), (3, 3, 'ordered', 2, 'First,:2| then:'), (3, 3, 'ordered', 3, 'First,:2| then:'),
        (4, 3, 'ordered', 1, 'x:'), (4, 3, 'ordered', 2, 'x:'), (4, 3, 'ordered', 3, 'x:'),
        (6, 4, 'paragraph', 1, 'Plain text!):1| ends [3].:'), (6, 4, 'paragraph', 2, 'Plain text!):1| ends [3].:'), (6, 4, 'paragraph', 3, 'Plain text!):1| ends.:3')) u(line, block, kind, n, statements) WHERE u.n = k.n""")
def answer_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and statements of an answer, of which one to three citations are known."""
    text = "## Rest\n- Eight days [1][2]. And **more** [9] of [1]\n- Two\n1. First [2], then\n2) x\n\nPlain text [1]!) ends [3]."
    rows = questions(spark, sf_dir).select("query_id", F.lit(text).alias("answer"), F.sequence(F.lit(1).cast("long"), (F.col("query_id") % 3 + 1).cast("long")).alias("known"))
    found = answers.answer_blocks(rows, "query_id", "answer", "known")
    flat = F.transform("statements", lambda s: F.concat(s["text"], F.lit(":"), F.array_join(F.transform(s["markers"], lambda n: n.cast("string")), ",")))
    return found.select("query_id", "line", "block", "kind", F.array_join(flat, "|").alias("statements"))


@query(f"""WITH {TOKENS_SQL}, {top_sql('t', 'bm25', 3)}, b AS (
        SELECT t.query_id, t.rank, '[' || t.rank || '] s. ' || d.doc_id || ' | ' || coalesce(d.lang, '') || ' | ' || CASE WHEN d.doc_id % 3 = 0 THEN 'SUPERSEDED, amended by ' || (d.doc_id + 1) || ', ' || coalesce(n.doc_id, -1) || ' (' || CASE WHEN s.rank IS NOT NULL OR n.rank IS NOT NULL THEN 'see block ' || concat_ws(', ', s.rank, n.rank) ELSE 'amending text not shown' END || ')' ELSE 'IN FORCE' END || chr(10) || d.text AS block
        FROM t JOIN documents d USING (doc_id) LEFT JOIN t s ON s.query_id = t.query_id AND s.doc_id = t.doc_id + 1 LEFT JOIN t n ON n.query_id = t.query_id AND n.rank = t.rank % 3 + 1
    ) SELECT b.query_id, md5('Region: ' || CASE WHEN b.query_id % 2 = 0 THEN 'the north' ELSE 'not given' END || chr(10) || chr(10) || CASE WHEN b.query_id % 5 = 0 THEN 'Note: only weekdays' || chr(10) || chr(10) ELSE '' END || 'Context:' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(q.text)) AS digest
    FROM b JOIN benchmark q ON q.item_id = b.query_id GROUP BY b.query_id""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole prompts: region, notes, blocks whose status names what amends them and where it stands, and the question."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = bm25_list(spark, sf_dir, 3)
    others = rows.select("query_id", F.col("doc_id").alias("other"), F.col("rank").alias("before"))
    rows = rows.withColumn("before", F.col("rank") % 3 + 1).join(others, ["query_id", "before"], "left").join(documents, "doc_id")
    places = rows.groupBy("query_id").agg(F.map_from_entries(F.collect_set(F.struct("doc_id", "rank"))).alias("shown"))
    amended = F.array(F.col("doc_id") + 1, F.coalesce("other", F.lit(-1)))
    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    status = answers.status_name(F.when(F.col("doc_id") % 3 == 0, "superseded").otherwise("in_force"), text(amended), F.col("names"))
    rows = rows.join(places.select("query_id", F.transform_keys("shown", lambda k, v: k.cast("string")).alias("names")), "query_id")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] s. "), F.col("doc_id").cast("string"), F.lit(" | "), F.coalesce("lang", F.lit("")), F.lit(" | "), status, F.lit("\n"), "text")
    context = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda s: s["block"]), "\n\n").alias("context"))
    notes = F.when(F.col("query_id") % 5 == 0, F.array(F.lit(" only weekdays "))).otherwise(F.array().cast("array<string>"))
    whole = answers.prompt(F.when(F.col("query_id") % 2 == 0, "the north"), notes, F.col("context"), F.col("text"))
    return context.join(questions(spark, sf_dir), "query_id").select("query_id", F.md5(whole).alias("digest"))


@query("SELECT count(*) AS problems, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS status, '2026-01-31' AS day FROM documents WHERE lang IS NULL OR n_chars < 50")
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated report of violations, read back, with the status that its run would end with."""
    wrong = table(spark, sf_dir, "documents").filter("lang IS NULL OR n_chars < 50").select("doc_id", "lang", "n_chars")
    status = tables.write_report(wrong, base := scratch(spark, "reports"), "corpus", "2026-01-31")
    return spark.read.schema("problems long, day string").json(f"{base}/2026-01-31_corpus/summary").select("problems", F.lit(status).alias("status"), "day")


@query(f"WITH {TOKENS_SQL} SELECT t.token, t.doc_id, t.tf, f.df, l.len FROM tf t JOIN dfs f USING (token) JOIN doclen l USING (doc_id) WHERE t.token BETWEEN 'l' AND 'o'")
def saved_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of tokens from the saved index: files without any of them are skipped by their bounds."""
    return search_index(spark, sf_dir).postings.filter("token BETWEEN 'l' AND 'o'").select("token", "doc_id", "tf", "df", "len")


@query("SELECT * FROM (VALUES ('a', 'Act 1', '1955'), ('b', 'Ordinance', NULL)) v(id, short_name, act_number)")
def yaml_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry file with two documents, read as rows."""
    text = "documents:\n  - id: a\n    short_name: Act 1\n    act_number: 1955\n  - id: b\n    short_name: Ordinance\n"
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(path := scratch(spark, "registry"))
    return tables.read_registry(spark, path, "documents").select("id", "short_name", "act_number")


@query("SELECT 'corpus: ' || count(DISTINCT source) || ' documents, ' || count(*) || ' chunks' AS meta, array_to_string(list_sort(list(DISTINCT source)), '; ') AS held, count(*) > 0 AS healthy FROM documents WHERE source IS NOT NULL")
def corpus_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is held, how much of it, and whether there is an index to ask."""
    rows = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    found = rows.agg(F.array_sort(F.collect_set("source")).alias("held"), F.count("*").alias("n"))
    text = F.concat(F.lit("corpus: "), F.size("held").cast("string"), F.lit(" documents, "), F.col("n").cast("string"), F.lit(" chunks"))
    return found.select(text.alias("meta"), F.array_join("held", "; ").alias("held"), (F.col("n") > 0).alias("healthy"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines FROM l WHERE line IS NULL OR NOT contains(line, 'License') GROUP BY doc_id")
def without_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return tables.without_mark(lines, "License").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("""WITH e AS (SELECT item_id AS query_id, item_id % 5 AS k, text FROM benchmark)
    SELECT query_id, CASE k WHEN 0 THEN 'event: stage' || chr(10) || 'data: {"stage":"generating"}' || chr(10) || chr(10) ELSE 'event: error' || chr(10) || 'data: {"status":' || CASE k WHEN 1 THEN 503 WHEN 2 THEN 502 WHEN 3 THEN 404 ELSE 500 END || ',"code":"' || CASE k WHEN 1 THEN 'generator_unavailable' WHEN 2 THEN 'generator_error' WHEN 3 THEN 'not_found' ELSE 'internal_error' END
        || '","message":"' || CASE k WHEN 1 THEN 'The answer service is not available for the moment. Please try again in a few minutes.' WHEN 2 THEN 'No answer could be produced this time. Please try again.' WHEN 3 THEN 'There is no provision with this id.' ELSE 'Something went wrong. Please try again.' END || '"}' || chr(10) || chr(10) END AS frame FROM e""")
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a stream's next message: a stage, or an error by its kind, without the error's own text."""
    k = F.col("query_id") % 5
    error = F.when(k == 1, models.EXPIRED).when(k == 2, "failed after 4 attempts: busy").when(k == 3, "not found").when(k == 4, F.concat(F.lit("ValueError: "), "text"))
    rows = questions(spark, sf_dir).withColumn("e", answers.public_error(error, models.EXPIRED, "failed after"))
    stage = answers.event_frame(F.lit("stage"), F.struct(F.lit("generating").alias("stage")))
    return rows.select("query_id", F.when(F.col("e").isNull(), stage).otherwise(answers.event_frame(F.lit("error"), F.col("e"))).alias("frame"))
