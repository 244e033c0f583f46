"""The catalogue of evaluation runs and their templates, as versioned tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramix.schema import RUNS
from engramix.storage import TableStore, materialize

TEMPLATES = "id string, name string, benchmark string, config string, updated_at string"


def list_runs(runs: DataFrame, equal: dict[str, str], most: int | None = None) -> DataFrame:
    """Runs with these values, the newest first."""
    for k, v in equal.items():
        runs = runs.where(F.col(k) == v)
    runs = runs.orderBy(F.desc("created_at"), "id")
    return runs.limit(most) if most is not None else runs


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("benchmark", "status").agg(F.count("*").alias("n"))


class RunCatalog:
    def __init__(self, store: TableStore):
        self.store = store

    def runs(self) -> DataFrame:
        return self.store.read("runs", RUNS)

    def insert(self, row: dict) -> None:
        names = [c.split()[0] for c in RUNS.split(", ")]
        self.store.append("runs", self.store.spark.createDataFrame([tuple(row.get(n) for n in names)], RUNS))

    def update(self, run_id: str, **values: object) -> None:
        rows = self.runs()
        changed = rows.withColumns({k: F.when(F.col("id") == run_id, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})
        self.store.write("runs", materialize(changed, "runs"))

    def delete(self, run_id: str) -> None:
        self.store.write("runs", materialize(self.runs().where(F.col("id") != run_id), "runs"))

    def get(self, run_id: str) -> DataFrame:
        return self.runs().where(F.col("id") == run_id)

    def upsert_template(self, row: dict) -> None:
        names = [c.split()[0] for c in TEMPLATES.split(", ")]
        self.store.append("templates", self.store.spark.createDataFrame([(*(row.get(n) for n in names), time.time_ns())], f"{TEMPLATES}, written bigint"))

    def templates(self) -> DataFrame:
        """The latest of each id; of one second, the one that was written last."""
        w = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("written"))
        return self.store.read("templates", f"{TEMPLATES}, written bigint").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "written")
