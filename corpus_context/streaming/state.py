"""A table of paths kept by a stream: a base and the changes of each micro-batch since.

A micro-batch reads the rows of the paths it touches and writes those that changed, under its own number, so that a
replayed batch rewrites its own. A row that is gone is a tombstone; with ``below`` it stands for everything under its
path as well, so that removing a folder writes one row. Every ``every`` batches the live rows are written as a new base;
what lies before the base before it is removed. Which folders hold the state before a batch follows from the batch's number
alone; if one is missing, reading fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_context.operators.moves import prefixes
from corpus_context.session import remove_path

KEY = ["root", "path"]


class PathState:
    def __init__(self, spark: SparkSession, folder: str, values: str, below: bool = False, seeded: bool = False, every: int = 10):
        self.spark, self.folder, self.below, self.seeded, self.every = spark, folder, below, seeded, every
        self.schema = f"root string, path string, {values}, gone boolean, batch long"
        self.types = {f.name: f.dataType for f in spark.createDataFrame([], self.schema).schema}
        self.values = [c for c in self.types if c not in (*KEY, "gone", "batch")]

    def seed(self, rows: DataFrame) -> None:
        """The rows (root, path, values) before the first batch."""
        self._live(rows, -1).write.mode("overwrite").parquet(f"{self.folder}/base=-1")

    def _live(self, rows: DataFrame, batch: int) -> DataFrame:
        return rows.select(*KEY, *self.values, F.lit(False).alias("gone"), F.lit(batch).cast("long").alias("batch"))

    def _rows(self, base: int, until: int) -> DataFrame:
        """The base after batch ``base`` and the changes of the batches after it, up to ``until``."""
        paths = [f"{self.folder}/delta={b}" for b in range(base + 1, until + 1)]
        if base >= 0 or self.seeded:
            paths.append(f"{self.folder}/base={base}")
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def before(self, batch: int, keys: DataFrame | None = None) -> DataFrame:
        """(root, path, values) of the live rows before ``batch``; only of ``keys`` (root, path) if given."""
        return self._resolved(self._rows(batch // self.every * self.every - 1, batch - 1), keys)

    def _resolved(self, rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
        mine = rows if keys is None else rows.join(keys.select(*KEY).distinct(), KEY, "left_semi")
        last = F.max_by(F.struct(*self.values, "gone"), F.struct("batch", ~F.col("gone")))
        mine = mine.groupBy(*KEY).agg(last.alias("v"), F.max("batch").alias("batch")).where("not v.gone").select(*KEY, "v.*", "batch")
        if self.below:
            gone = rows.where("gone").groupBy("root", F.col("path").alias("up")).agg(F.max("batch").alias("removed"))
            at = mine.select(*KEY, F.explode(prefixes("path")).alias("up")).join(gone, ["root", "up"])
            mine = mine.join(at.groupBy(*KEY).agg(F.max("removed").alias("removed")), KEY, "left").where("removed is null or removed <= batch")
        return mine.select(*KEY, *self.values)

    def commit(self, batch: int, rows: DataFrame, gone: DataFrame) -> None:
        """The changes of ``batch``: its live ``rows`` (root, path, values) and the paths ``gone`` (root, path); a path in both lives."""
        none = [F.lit(None).cast(self.types[c]).alias(c) for c in self.values]
        dead = gone.select(*KEY).distinct().select(*KEY, *none, F.lit(True).alias("gone"), F.lit(batch).cast("long").alias("batch"))
        self._live(rows, batch).unionByName(dead).write.mode("overwrite").parquet(f"{self.folder}/delta={batch}")
        if (batch + 1) % self.every == 0:
            base = batch - self.every
            live = self._resolved(self._rows(base, batch))
            self._live(live, batch).write.mode("overwrite").parquet(f"{self.folder}/base={batch}")
            remove_path(self.spark, f"{self.folder}/base={base - self.every}")
            for b in range(base - self.every + 1, base + 1):
                remove_path(self.spark, f"{self.folder}/delta={b}")
