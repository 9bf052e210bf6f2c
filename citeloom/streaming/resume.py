"""A batch of questions that can be stopped and resumed.

Questions arrive as JSON files; what is new since the last run is taken once,
and ids that already have an answer are skipped, so that a run that ended
between writing and its checkpoint writes nothing twice.  Rows with an error are
not written; if one says that the session has expired, the run says so, and a
later run takes these questions again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeloom.operators.models import EXPIRED
from citeloom.sources.scratch import written
from citeloom.sources.tables import exists


def answer_new(spark: SparkSession, questions: str, schema: StructType, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "query_id") -> int:
    """Answer all questions that are there and not answered yet, and append them to ``out``: 0, or 2 if the session expired before all were."""
    status = [0]

    def unanswered(rows: DataFrame) -> DataFrame:
        fresh = rows.dropDuplicates([key])
        if exists(spark, f"{out}/_SUCCESS"):  # any other trouble with what is there ends the run, nothing is answered twice
            fresh = fresh.join(spark.read.parquet(out).select(key), key, "left_anti")
        return fresh

    def add(fresh: DataFrame) -> None:
        found = answer(fresh)
        if "error" in found.columns:
            found = written(found, "answers")  # no question is asked again for another look at its row
            if not found.filter(F.col("error") == EXPIRED).isEmpty():
                status[0] = 2
            found = found.filter("error IS NULL").drop("error")
        found.write.mode("append").parquet(out)

    left = f"{checkpoint}-unanswered"
    if exists(spark, f"{left}/_SUCCESS"):  # what an expired session left; taken from the stream already
        add(unanswered(spark.read.schema(schema).json(left)))

    def each(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").option("ignoreNullFields", "false").json(left)
        add(unanswered(batch))

    stream = spark.readStream.schema(schema).json(questions)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return status[0]
