"""A sink that puts failed ids back: each micro-batch works on its own ids and on those that failed before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class Requeue:
    """For ``foreachBatch``: runs ``work`` on (id, tries) of a batch, one run at a time.

    ``work`` returns the ids that failed. These wait, with one more try, for
    the next batch; they start none themselves. Each id counts once a batch,
    with the most tries it has. What a batch has done and what it left lie in
    ``folder`` under its number, so a batch that is run again after a loss
    overwrites its own outcome and nothing is worked on twice in the record.
    """

    def __init__(self, folder: str, work: Callable[[DataFrame], DataFrame]):
        self.folder, self.work = folder, work

    def part(self, kind: str, batch_id: int) -> str:
        return f"{self.folder}/{kind}/batch={batch_id}"

    def left(self, spark, batch_id: int) -> DataFrame:
        """(id, tries) that batch ``batch_id`` left; none before the first."""
        try:
            return spark.read.schema("id long, tries int").parquet(self.part("left", batch_id))
        except AnalysisException:
            return spark.createDataFrame([], "id long, tries int")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.filter(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.lit(0).alias("tries"))
        todo = new.unionByName(self.left(spark, batch_id - 1)).groupBy("id").agg(F.max("tries").alias("tries"))
        todo.write.mode("overwrite").parquet(self.part("todo", batch_id))
        todo = spark.read.schema("id long, tries int").parquet(self.part("todo", batch_id))
        failed = self.work(todo).select("id").distinct().withColumn("failed", F.lit(True))
        self.work_done(todo.join(failed, "id", "left"), batch_id)

    def work_done(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self.part("outcome", batch_id))
        rows = rows.sparkSession.read.schema(rows.schema).parquet(self.part("outcome", batch_id))
        rows.filter("failed is null").select("id", "tries").write.mode("overwrite").parquet(self.part("done", batch_id))
        rows.filter("failed").select("id", (F.col("tries") + 1).alias("tries")).write.mode("overwrite").parquet(self.part("left", batch_id))

    def done(self, spark) -> DataFrame:
        """(id, tries, batch) of all that was done."""
        return spark.read.schema("id long, tries int, batch long").parquet(f"{self.folder}/done")
