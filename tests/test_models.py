import pytest
from pyspark.sql import functions as F

from citeloom.operators import answers, models
from citeloom.sources import saved as S
from citeloom.sources import tables
from citeloom.streaming.resume import answer_new


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_encoder(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"word {i} and more") for i in range(40)] + [(40, "")], "id int, text string")
    found = {r.id: r.v for r in rows.select("id", models.embedded(F.col("text")).alias("v")).collect()}
    assert found[3] is None and found[40] == [0.0] * 16 and all(abs(sum(x * x for x in v) - 1) < 1e-9 for i, v in found.items() if i not in (3, 40))
    assert rows.limit(0).select(models.embedded(F.col("text"))).count() == 0


def test_detector(spark):
    rows = spark.createDataFrame([(1, "the zzz abcdefghijkl"), (2, None), (3, "ZZZ zzz The")], "id int, text string")
    found = models.detected_words(rows, "id", "text", ["the"], lambda: lambda w: 0.5 if len(w) > 9 else 0.4)
    assert sorted(map(tuple, found.collect())) == [(1, 3, 2), (2, 0, 0), (3, 3, 1)]


def flaky(fails, expires=()):
    def make():
        calls = {}

        def call(prompt):
            calls[prompt] = calls.get(prompt, 0) + 1
            if prompt in expires:
                raise models.SessionExpired
            if calls[prompt] <= fails.get(prompt, 0):
                raise models.Transient("busy")
            return f"re: {prompt} after {calls[prompt]}", "stop"

        return call

    return make




def test_ask(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "query_id long, prompt string").coalesce(1)
    found = models.ask(rows, flaky({"b": 3, "c": 4}, {"d"}), wait=lambda _: None).orderBy("query_id").collect()
    assert [(r.reply, r.error) for r in found] == [("re: a after 1", None), ("re: b after 4", None), (None, "failed after 4 attempts: busy"), (None, models.EXPIRED), (None, models.EXPIRED)]
    assert models.ask(rows.limit(0), flaky({})).count() == 0


def test_expired_run_is_taken_up(spark, tmp_path):
    schema = "query_id long, prompt string"
    rows = spark.createDataFrame([(i, "abcdef"[i]) for i in range(6)], schema)
    rows.coalesce(1).write.json(f"{tmp_path}/questions")
    run = lambda expires: answer_new(spark, f"{tmp_path}/questions", rows.schema, lambda q: models.ask(q.coalesce(1).sortWithinPartitions("query_id"), flaky({}, expires), wait=lambda _: None), f"{tmp_path}/answers", f"{tmp_path}/checkpoint")
    assert run({"c"}) == 2
    first = {r.query_id for r in spark.read.parquet(f"{tmp_path}/answers").collect()}
    assert len(first) < 6
    assert run(()) == 0
    assert sorted(r.query_id for r in spark.read.parquet(f"{tmp_path}/answers").collect()) == list(range(6))
    assert run(()) == 0 and spark.read.parquet(f"{tmp_path}/answers").count() == 6


@pytest.mark.parametrize("reply, sentence", [('Rewritten question: "How many?"\nmore', "How many?"), ("\n  “x y”", "x y"), ("Query: a", "a"), ("", None), (None, None)])
def test_rewrite(spark, reply, sentence):
    assert one(spark, models.clean_rewrite(F.lit(reply))) == sentence


def test_added_numbers(spark):
    added = lambda a, b: one(spark, models.added_numbers(F.lit(a), F.lit(b)))
    assert added("two days of 3.5", "Two or twenty-one days, 3.5 or 4, twenty-one") == ["twenty-one", "4"]
    assert added("", "none at all") == []


def test_status_names(spark):
    name = lambda status, amended, shown: one(spark, answers.status_name(F.lit(status), F.array(*map(F.lit, amended)).cast("array<string>"), F.create_map(*(x for k, v in shown.items() for x in (F.lit(k), F.lit(v)))).cast("map<string,int>")))
    assert name("in_force", [], {"x": 1}) == "IN FORCE" and name("odd", [], {"x": 1}) == "odd"
    assert name("superseded", ["a", "b"], {"b": 2}) == "SUPERSEDED, amended by a, b (see block 2)"
    assert name("superseded", ["a"], {"b": 2}) == "SUPERSEDED, amended by a (amending text not shown)"


def test_report_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é")], "id int, problem string")
    assert tables.write_report(rows, f"{tmp_path}/r", "check", "2026-01-01") == 1 and tables.write_report(rows.limit(0), f"{tmp_path}/r", "check", "2026-01-02") == 0
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"12345")
    assert [(r.length, bytes(r.content)) for r in tables.read_files(spark, f"{tmp_path}/f", "*.bin").collect()] == [(5, b"12345")]
    assert tables.without_mark(rows.withColumnRenamed("problem", "line"), None).count() == 1 and tables.without_mark(rows.withColumnRenamed("problem", "line"), "é").count() == 0


def test_saved_follows_its_files(spark, tmp_path):
    built = []

    def build(df):
        built.append(1)
        return df.groupBy().count()

    for n in (3, 3, 5):
        if n == 5 or not built:
            spark.range(n).write.mode("overwrite").parquet(f"{tmp_path}/t")
        df = spark.read.parquet(f"{tmp_path}/t")
        assert S.saved(spark, "counted", [df], lambda df=df: build(df)).first()["count"] == n
    assert len(built) == 2
