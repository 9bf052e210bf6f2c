"""Gate calibration and retrieval evaluation.

A benchmark item is in scope if some document contains its text.  Its two
scores are its best BM25 score and its best cosine, each mapped to 0..1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.text import script_gate, tokens
from citeloom.operators import evaluate, gate, rank
from citeloom.plans.base import query, table
from citeloom.plans.corpus import GATE_SQL
from citeloom.plans.ranking import DENSE_SQL, MODES_SQL, SECTIONS_SQL, TOKENS_SQL, asked_postings, bm25_list, dense_list, final_list, modes, questions, rescored, top_sql
from citeloom.sources.saved import saved

EXPECTED_SQL = "expected AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
SCORED_SQL = f"""{TOKENS_SQL}, {DENSE_SQL}, {EXPECTED_SQL}, scored AS (
        SELECT b.item_id AS id, b.item_id IN (SELECT query_id FROM expected) AS in_scope, round(coalesce(s.s, 0) / (coalesce(s.s, 0) + 10), 6) AS score, round((coalesce(x.x, -1) + 1) / 2, 6) AS rew
        FROM benchmark b LEFT JOIN (SELECT query_id, max(score) AS s FROM bm25 GROUP BY query_id) s ON s.query_id = b.item_id
        LEFT JOIN (SELECT query_id, max(score) AS x FROM dense GROUP BY query_id) x ON x.query_id = b.item_id
    )"""


#: Items without a token that are sought in all texts at once.
SHORT_ITEMS = 500


def find_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id) of documents that contain an item's text.

    Whoever contains the text contains its rarest inner token, so only those
    documents are searched; items without a token are sought SHORT_ITEMS at a time.
    """
    documents, items = table(spark, sf_dir, "documents").filter("text IS NOT NULL"), questions(spark, sf_dir).filter("text IS NOT NULL")
    inner = F.expr("slice(tokens, 2, greatest(size(tokens) - 2, 1))")  # the first and the last may be parts of longer words
    asked = items.withColumn("tokens", tokens(F.col("text"))).select("query_id", F.explode_outer(F.array_distinct(inner)).alias("token"))
    postings = asked_postings(spark, sf_dir)
    posts = rank.meeting(postings, asked.select("token").filter("token IS NOT NULL").distinct())
    df = posts.groupBy("token").agg(F.max("df").alias("df"))
    rarest = asked.join(df, "token").groupBy("query_id").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    near = rank.meeting(postings.select("token", "doc_id"), rarest).join(items.withColumnRenamed("text", "wanted"), "query_id").join(documents.select("doc_id", "text"), "doc_id")
    found = near.filter(F.contains(F.col("text"), F.col("wanted"))).select("query_id", "doc_id")
    short = [(r.query_id, r.text) for r in items.filter(F.size(tokens(F.col("text"))) == 0).collect()]
    for at in range(0, len(short), SHORT_ITEMS):
        some = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(t).alias("wanted")) for i, t in short[at : at + SHORT_ITEMS]))
        hits = documents.select("doc_id", F.explode(F.filter(some, lambda s: F.contains(F.col("text"), s["wanted"]))).alias("s"))
        found = found.union(hits.select("s.id", "doc_id"))
    return found


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved table of ``find_expected``."""
    return saved(spark, "expected", [table(spark, sf_dir, t) for t in ("documents", "benchmark")], lambda: find_expected(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, in_scope, score (from BM25) and rew (from cosine)."""
    inside = expected(spark, sf_dir).select("query_id").distinct().withColumn("hit", F.lit(True))
    sparse = bm25_list(spark, sf_dir, 1).select("query_id", F.col("score").alias("s"))
    dense = dense_list(spark, sf_dir, 1).select("query_id", F.col("score").alias("x"))
    rows = questions(spark, sf_dir).select("query_id").join(inside, "query_id", "left").join(sparse, "query_id", "left").join(dense, "query_id", "left")
    s = F.coalesce("s", F.lit(0.0))
    return rows.select(F.col("query_id").alias("id"), F.coalesce("hit", F.lit(False)).alias("in_scope"), F.round(s / (s + 10), 6).alias("score"), F.round((F.coalesce("x", F.lit(-1.0)) + 1) / 2, 6).alias("rew"))


@query(f"WITH {EXPECTED_SQL} SELECT * FROM expected")
def expected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_expected(spark, sf_dir)


@query(f"WITH {SCORED_SQL} SELECT id, in_scope, score, rew FROM scored")
def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


@query(f"WITH {SCORED_SQL} SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auc FROM scored a, scored b WHERE a.in_scope AND NOT b.in_scope")
def gate_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.roc_auc(scored(spark, sf_dir))


@query("""WITH l AS (SELECT l.quality = 1 AS in_scope, d.n_chars AS score FROM labels l JOIN documents d USING (doc_id)),
    r AS (SELECT *, avg(rn) OVER (PARTITION BY score) AS ar FROM (SELECT *, row_number() OVER (ORDER BY score) AS rn FROM l))
    SELECT (sum(ar) FILTER (WHERE in_scope) - count(*) FILTER (WHERE in_scope) * (count(*) FILTER (WHERE in_scope) + 1) / 2) / (count(*) FILTER (WHERE in_scope) * count(*) FILTER (WHERE NOT in_scope)) AS auc FROM r""")
def label_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return gate.roc_auc(rows.select((F.col("quality") == 1).alias("in_scope"), F.col("n_chars").alias("score")))


@query(f"""WITH {SCORED_SQL}, i AS (SELECT score, row_number() OVER (ORDER BY score, id) AS pos, count(*) OVER () AS n FROM scored WHERE in_scope)
    SELECT score AS threshold FROM i WHERE pos = least(CAST(floor(0.1 * n + 1e-9) AS BIGINT), n - 1) + 1""")
def gate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.order_statistic(scored(spark, sf_dir))


@query(f"""WITH {SCORED_SQL}, o AS (SELECT score, row_number() OVER (ORDER BY score, id) AS pos, count(*) OVER () AS n FROM scored WHERE NOT in_scope)
    SELECT nextafter(score, CAST('Infinity' AS DOUBLE)) AS threshold FROM o WHERE pos = ceil(0.7 * n - 1e-9)""")
def nextafter_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.out_of_scope_threshold(scored(spark, sf_dir))


@query(f"""WITH {SCORED_SQL} SELECT coalesce(avg(CAST(score < 0.8 AS DOUBLE)) FILTER (WHERE in_scope), 0) AS in_declined, coalesce(avg(CAST(score < 0.8 AS DOUBLE)) FILTER (WHERE NOT in_scope), 0) AS out_declined FROM scored""")
def gate_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.rates(scored(spark, sf_dir), 0.8)


FOLDS_SQL = f"""{SCORED_SQL}, placed AS (SELECT *, CAST((row_number() OVER (PARTITION BY in_scope ORDER BY id) - 1) % 5 AS INT) AS fold FROM scored)"""
TUNED_SQL = f"""{FOLDS_SQL}, train AS (SELECT p.*, CAST(f.range AS INT) AS test FROM placed p, range(5) f WHERE p.fold <> f.range), o AS (
        SELECT test, score, row_number() OVER (PARTITION BY test ORDER BY score, id) AS pos, count(*) OVER (PARTITION BY test) AS n FROM train WHERE in_scope
    ), tuned AS (SELECT test AS fold, score AS threshold FROM o WHERE pos = least(CAST(floor(0.1 * n + 1e-9) AS BIGINT), n - 1) + 1)"""


@query(f"WITH {FOLDS_SQL} SELECT id, in_scope, fold FROM placed")
def fold_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.folds(scored(spark, sf_dir)).select("id", "in_scope", "fold")


@query(f"WITH {TUNED_SQL} SELECT fold, threshold FROM tuned")
def kfold_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.kfold_abstention(scored(spark, sf_dir))[0]


@query(f"WITH {TUNED_SQL} SELECT avg(CAST(score < threshold AS DOUBLE)) FILTER (WHERE in_scope) AS in_declined, avg(CAST(score < threshold AS DOUBLE)) FILTER (WHERE NOT in_scope) AS out_declined FROM placed JOIN tuned USING (fold)")
def kfold_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.kfold_abstention(scored(spark, sf_dir))[1]


def _rule_sql(value: str, source: str) -> str:
    return f"""WITH {FOLDS_SQL}, v AS (SELECT *, {value} AS own FROM placed), train AS (SELECT v.*, f.range AS test FROM v, range(5) f WHERE v.fold <> f.range AND NOT v.in_scope), o AS (
        SELECT test, own, row_number() OVER (PARTITION BY test ORDER BY own) AS pos, count(*) OVER (PARTITION BY test) AS n FROM train
    ) SELECT v.id, v.in_scope, v.fold, v.own > o.own AS passed, {source} AS source FROM v JOIN o ON o.test = v.fold AND o.pos = ceil(0.7 * o.n - 1e-9)"""


def _two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumnRenamed("score", "orig")


@query(_rule_sql("score", "'orig'"))
def gate_rules_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.rule_votes(_two_scores(spark, sf_dir), "baseline")


@query(_rule_sql("rew", "'rew'"))
def gate_rules_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.rule_votes(_two_scores(spark, sf_dir), "rewrite")


@query(_rule_sql("greatest(score, rew)", "CASE WHEN v.score >= v.rew THEN 'orig' ELSE 'rew' END"))
def gate_rules_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.rule_votes(_two_scores(spark, sf_dir), "max")


_BASE_SQL = f"""WITH {FOLDS_SQL}, train AS (SELECT p.*, f.range AS test FROM placed p, range(5) f WHERE p.fold <> f.range), o AS (
        SELECT test, score, row_number() OVER (PARTITION BY test ORDER BY score) AS pos, count(*) OVER (PARTITION BY test) AS n FROM train WHERE NOT in_scope
    ), t AS (SELECT test, score AS t, ceil(0.7 * n - 1e-9) AS enough FROM o WHERE pos = ceil(0.7 * n - 1e-9))"""


@query(f"""{_BASE_SQL}, c AS (  -- parameters: a score passes if it is beyond c, or reaches c where same holds
        SELECT test, t AS c, FALSE AS same FROM t UNION SELECT test, CAST('Infinity' AS DOUBLE), FALSE FROM t
        UNION SELECT x.test, x.rew, FALSE FROM train x JOIN t ON t.test = x.test WHERE NOT x.in_scope AND x.rew > t.t
    ), ok AS (
        SELECT c.test, min(c.c) AS c FROM c JOIN t ON t.test = c.test
        WHERE (SELECT count(*) FROM train x WHERE x.test = c.test AND NOT x.in_scope AND NOT (x.score > t.t OR x.rew > c.c)) >= t.enough GROUP BY c.test
    ) SELECT p.id, p.in_scope, p.fold, p.score > t.t OR p.rew > ok.c AS passed, CASE WHEN p.score > t.t THEN 'orig' ELSE 'rew' END AS source
    FROM placed p JOIN t ON t.test = p.fold JOIN ok ON ok.test = p.fold""")
def gate_rules_or_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.rule_votes(_two_scores(spark, sf_dir), "or_strict")


@query(f"""{_BASE_SQL}, c AS (
        SELECT DISTINCT x.test, x.score AS c FROM train x JOIN t ON t.test = x.test WHERE x.score <= t.t UNION SELECT test, nextafter(t, CAST('Infinity' AS DOUBLE)) FROM t
    ), ok AS (
        SELECT c.test, min(c.c) AS c FROM c JOIN t ON t.test = c.test
        WHERE (SELECT count(*) FROM train x WHERE x.test = c.test AND NOT x.in_scope AND NOT (x.score > t.t OR (x.score >= c.c AND x.rew > t.t))) >= t.enough GROUP BY c.test
    ) SELECT p.id, p.in_scope, p.fold, p.score > t.t OR (p.score >= ok.c AND p.rew > t.t) AS passed, CASE WHEN p.score > t.t THEN 'orig' ELSE 'rew' END AS source
    FROM placed p JOIN t ON t.test = p.fold JOIN ok ON ok.test = p.fold""")
def gate_rules_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.rule_votes(_two_scores(spark, sf_dir), "band")


@query(f"""WITH {TUNED_SQL}, v AS (SELECT id, -id AS variant, fold, score FROM placed)
    SELECT v.variant AS id, v.fold, t.fold AS by_fold, v.score >= t.threshold AS passed FROM v, tuned t""")
def fold_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fold's parameters vote on a variant of each item."""
    items = scored(spark, sf_dir)
    tuned, _ = gate.kfold_abstention(items)
    votes = gate.folds(items).crossJoin(F.broadcast(tuned.withColumnRenamed("fold", "by_fold")))  # five rows
    return votes.select((-F.col("id")).alias("id"), "fold", "by_fold", (F.col("score") >= F.col("threshold")).alias("passed"))


RECORDS_SQL = f"""{MODES_SQL}, {EXPECTED_SQL}, gold AS (SELECT query_id, list(DISTINCT doc_id ORDER BY doc_id) AS expected FROM expected GROUP BY query_id), records AS (
        SELECT mode, query_id, list(doc_id ORDER BY rank) AS ranked FROM ranked GROUP BY mode, query_id
    ), m AS (
        SELECT r.mode, r.query_id, CASE WHEN r.query_id % 3 = 0 THEN 'north' WHEN r.query_id % 3 = 1 THEN 'south' END AS region, CASE WHEN r.query_id % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty,
            CAST(list_has_any(ranked[1:1], expected) AS DOUBLE) AS hit1, CAST(list_has_any(ranked[1:5], expected) AS DOUBLE) AS hit5,
            coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(ranked, lambda x, i: CASE WHEN list_contains(expected, x) THEN i END), lambda p: p IS NOT NULL)), 0) AS mrr,
            len(list_intersect(ranked[1:5], expected)) / len(expected) AS recall_top5, len(list_intersect(ranked, expected)) / len(expected) AS recall_final,
            len(list_intersect(ranked, expected)) / len(ranked) AS id_precision, len(list_intersect(ranked, expected)) / len(expected) AS id_recall
        FROM records r JOIN gold USING (query_id)
    )"""
_MEANS_SQL = ", ".join(f"round(avg({m}), 3) AS {m}" for m in evaluate.METRICS)


def measured_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records of the three modes, gate off, joined with gold items that expect something."""
    ranked, _ = modes(spark, sf_dir)
    records = ranked.groupBy("mode", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"]).alias("ranked"))
    gold = expected(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("expected"))
    region = F.when(F.col("query_id") % 3 == 0, "north").when(F.col("query_id") % 3 == 1, "south")
    rows = records.join(gold, "query_id").withColumns({"final": F.col("ranked"), "region": region, "difficulty": F.when(F.col("query_id") % 2 == 0, "easy").otherwise("hard")})
    return evaluate.measured(rows)


@query(f"WITH {RECORDS_SQL} SELECT mode, query_id, hit1, hit5, round(mrr, 6) AS mrr, round(recall_top5, 6) AS recall_top5, round(id_precision, 6) AS id_precision FROM m")
def records_x_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured_records(spark, sf_dir)
    return rows.select("mode", "query_id", "hit1", "hit5", *(F.round(c, 6).alias(c) for c in ("mrr", "recall_top5", "id_precision")))


@query(f"WITH {RECORDS_SQL} SELECT mode, CAST(grouping_id(region, difficulty) AS BIGINT) AS grouping, region, difficulty, count(*) AS items, {_MEANS_SQL} FROM m GROUP BY GROUPING SETS ((mode), (mode, region), (mode, difficulty))")
def retrieval_metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means overall, by region and by difficulty; grouping tells a null region from a total."""
    rows = measured_records(spark, sf_dir)
    mode, region, difficulty = map(F.col, ("mode", "region", "difficulty"))
    sets = rows.groupingSets([[mode], [mode, region], [mode, difficulty]], mode, region, difficulty)
    means = (F.round(F.avg(m), 3).alias(m) for m in evaluate.METRICS)
    return sets.agg(F.grouping_id().alias("grouping"), F.count("*").alias("items"), *means).select("mode", (F.col("grouping") % 4).alias("grouping"), "region", "difficulty", "items", *evaluate.METRICS)


@query(f"""WITH {RECORDS_SQL}, p AS (SELECT mode, count(*) AS items, {_MEANS_SQL} FROM m GROUP BY mode), a AS (
        SELECT g.mode, b.item_id AS id, coalesce(g.gate, -1.0) AS score, b.item_id IN (SELECT query_id FROM expected) AS in_scope FROM benchmark b CROSS JOIN thresholds t LEFT JOIN gates g ON g.mode = t.mode AND g.query_id = b.item_id
    ), u AS (SELECT x.mode, round(avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM a x JOIN a y ON y.mode = x.mode WHERE x.in_scope AND NOT y.in_scope GROUP BY x.mode)
    SELECT p.*, u.auc FROM p LEFT JOIN u USING (mode)""")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mode: metric means of in-scope items, and the gate's AUC over all items (no score counts as -1)."""
    rows = measured_records(spark, sf_dir)
    means = rows.groupBy("mode").agg(F.count("*").alias("items"), *(F.round(F.avg(m), 3).alias(m) for m in evaluate.METRICS))
    _, gates = modes(spark, sf_dir)
    inside = expected(spark, sf_dir).select("query_id").distinct().withColumn("hit", F.lit(True))
    every = questions(spark, sf_dir).select("query_id", F.explode(F.array(F.lit("dense"), F.lit("hybrid"), F.lit("hybrid_rerank"))).alias("mode")).join(gates, ["mode", "query_id"], "left").join(inside, "query_id", "left")
    items = every.select("mode", F.coalesce("hit", F.lit(False)).alias("in_scope"), F.coalesce("gate", F.lit(-1.0)).alias("score"))
    by = items.groupBy("mode", "score").agg(F.sum(F.col("in_scope").cast("long")).alias("pos"), F.sum((~F.col("in_scope")).cast("long")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("mode").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = by.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2)).groupBy("mode").agg(F.round(F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), 6).alias("auc"))
    return means.join(wins, "mode", "left")


@query(f"""WITH {SCORED_SQL}, asked AS (SELECT item_id AS id, CASE WHEN item_id % 7 = 3 THEN 'Это другой язык ' || item_id ELSE text END AS text FROM benchmark), {GATE_SQL}, kept AS (SELECT x.* FROM scored x JOIN p ON p.id = x.id WHERE p.passed),
    i AS (SELECT score, row_number() OVER (ORDER BY score, id) AS pos, count(*) OVER () AS n FROM kept WHERE in_scope), t AS (
        SELECT score AS threshold FROM i WHERE pos = least(CAST(floor(0.1 * n + 1e-9) AS BIGINT), n - 1) + 1)
    SELECT threshold, count(*) FILTER (WHERE s.in_scope) AS in_scope_items, count(*) FILTER (WHERE NOT s.in_scope) AS out_items,
        count(*) FILTER (WHERE s.in_scope AND s.score < threshold) AS in_declined, count(*) FILTER (WHERE NOT s.in_scope AND s.score < threshold) AS out_declined
    FROM kept s, t GROUP BY threshold""")
def calibrate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration that leaves out the questions that the language gate stops (every seventh is asked in another script here)."""
    asked = F.when(F.col("query_id") % 7 == 3, F.concat(F.lit("Это другой язык "), F.col("query_id").cast("string"))).otherwise(F.col("text"))
    passed = questions(spark, sf_dir).filter(script_gate(asked)["passed"]).select(F.col("query_id").alias("id"))
    items = scored(spark, sf_dir).join(passed, "id", "left_semi")
    low = F.col("score") < F.col("threshold")
    rows = items.crossJoin(F.broadcast(gate.order_statistic(items)))  # one row
    return rows.groupBy("threshold").agg(
        F.count_if("in_scope").alias("in_scope_items"), F.count_if(~F.col("in_scope")).alias("out_items"), F.count_if(F.col("in_scope") & low).alias("in_declined"), F.count_if(~F.col("in_scope") & low).alias("out_declined")
    )


@query(f"WITH {EXPECTED_SQL}, g AS (SELECT b.item_id, count(e.doc_id) AS n FROM benchmark b LEFT JOIN expected e ON e.query_id = b.item_id GROUP BY b.item_id) SELECT item_id AS query_id, n > 0 AS in_scope, CASE WHEN n > 0 THEN 'retrieval' ELSE 'abstention' END AS subset FROM g")
def eval_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = expected(spark, sf_dir).select("query_id").distinct().withColumn("hit", F.lit(True))
    hit = F.coalesce("hit", F.lit(False))
    return questions(spark, sf_dir).join(inside, "query_id", "left").select("query_id", hit.alias("in_scope"), F.when(hit, "retrieval").otherwise("abstention").alias("subset"))



_CUTS = (0.0, 0.3, 0.5, 0.9)
_EXPERIMENT_SQL = "SELECT x.rule, c.cut, x.query_id, list(x.doc_id) FILTER (WHERE x.score >= c.cut * x.best) AS chosen FROM x, (VALUES (0.0), (0.3), (0.5), (0.9)) c(cut) GROUP BY x.rule, c.cut, x.query_id"


@query(f"""WITH {SECTIONS_SQL}, {EXPECTED_SQL}, gold AS (SELECT query_id, list(DISTINCT doc_id) AS expected FROM expected GROUP BY query_id), pool AS (
        SELECT p.query_id, p.doc_id, c.score FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
            SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM b40 WHERE rank <= 20 UNION ALL SELECT * FROM d40 WHERE rank <= 20) GROUP BY query_id, doc_id)) p JOIN cs c ON c.query_id = p.query_id AND c.doc_id = p.doc_id WHERE p.rank <= 20
    ), {top_sql('base', 'pool', 5)}, {top_sql('wide', 'rescored', 5)}, x AS (
        SELECT 'baseline' AS rule, *, max(score) OVER (PARTITION BY query_id) AS best FROM base UNION ALL SELECT 'section', *, max(score) OVER (PARTITION BY query_id) FROM wide
    ), e AS ({_EXPERIMENT_SQL})
    SELECT rule, CAST(cut AS DOUBLE) AS cut, count(*) AS n, round(avg(len(list_intersect(chosen, expected)) / len(expected)), 3) AS recall, round(avg(len(list_intersect(chosen, expected)) / len(chosen)), 3) AS precision,
        round(avg(len(chosen)), 2) AS mean_size, round(avg(CASE WHEN list_has_any(chosen, expected) THEN 1.0 ELSE 0.0 END), 3) AS hit FROM e JOIN gold USING (query_id) GROUP BY rule, cut""")
def relevance_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut-offs of the final list and of the list rescored by sections, over in-scope items: recall, precision, size and hits."""
    gold = expected(spark, sf_dir).groupBy("query_id").agg(F.collect_set("doc_id").alias("expected"))
    rules = {"baseline": final_list(spark, sf_dir).filter(F.col("rank") <= rank.TOP_FINAL), "section": rank.top(rescored(spark, sf_dir), rank.TOP_FINAL)}
    rows = None
    for rule, found in rules.items():
        one = found.select(F.lit(rule).alias("rule"), "query_id", "doc_id", "score")
        rows = one if rows is None else rows.unionByName(one)
    best = F.max("score").over(Window.partitionBy("rule", "query_id"))
    cut = rows.withColumn("best", best).withColumn("cut", F.explode(F.array(*map(F.lit, _CUTS)))).filter(F.col("score") >= F.col("cut") * F.col("best"))
    chosen = cut.groupBy("rule", "cut", "query_id").agg(F.collect_set("doc_id").alias("chosen")).join(gold, "query_id")
    hits = F.size(F.array_intersect("chosen", "expected"))
    return chosen.groupBy("rule", "cut").agg(
        F.count("*").alias("n"), F.round(F.avg(hits / F.size("expected")), 3).alias("recall"), F.round(F.avg(hits / F.size("chosen")), 3).alias("precision"),
        F.round(F.avg(F.size("chosen")), 2).alias("mean_size"), F.round(F.avg((hits > 0).cast("double")), 3).alias("hit"),
    )
