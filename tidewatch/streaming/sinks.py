"""Where a stream's batches go: alerts and notes, each once, though a batch that was under way runs again after a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Written:
    """Batches as JSON lines, each in a folder of its own number that is written anew when the batch runs again."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").json(f"{self.folder}/batch={batch}")


class Shown:
    """Batches for people: what `show` makes of a batch is done unless the folder holds the batch's mark, which is set afterwards.

    Without a folder nothing is remembered. A process that dies between the two shows its last batch again.
    """

    def __init__(self, spark: SparkSession, show: Callable[[DataFrame], None], folder: str | None):
        self.spark, self.show, self.folder = spark, show, folder

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if self.folder is None:
            return self.show(rows)
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch-{batch}")
        files = mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(mark):
            self.show(rows)
            files.create(mark, True).close()
            if batch:  # marks before the last one are never asked for again
                files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch-{batch - 1}"), False)


def to_each(*sinks: tuple[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each sink gets the batch's rows that fit its condition; the batch is computed once."""

    def run(rows: DataFrame, batch: int) -> None:
        held = rows.persist()
        try:
            for condition, sink in sinks:
                sink(held.where(condition), batch)
        finally:
            held.unpersist()

    return run
