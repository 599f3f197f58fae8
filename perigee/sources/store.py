"""A small keyed store on Parquet: whole-row upserts, scans, range deletes. A write goes to a new version
and then becomes current, so a reader never sees half of it and a failed write leaves the old version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from perigee.operators.resolve import last_wins


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self) -> DataFrame | None:
        try:
            return self.spark.read.json(f"{self.path}/_current", schema="table string, version string, seq long")
        except AnalysisException:
            return None

    def _versions(self) -> dict[str, tuple[str, int]]:
        p = self._pointer()
        if p is None:
            return {}
        return {r["table"]: (r["version"], r["seq"]) for r in p.groupBy("table").agg(F.max_by("version", "seq").alias("version"), F.max("seq").alias("seq")).collect()}

    def read(self, table: str) -> DataFrame | None:
        at = self._versions().get(table)
        return self.spark.read.parquet(f"{self.path}/{table}/{at[0]}") if at else None

    def write(self, table: str, rows: DataFrame) -> None:
        """Writes a new version, then appends a pointer to it: the append is the commit."""
        seq = self._versions().get(table, ("", 0))[1] + 1
        version = f"v{seq}_{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{table}/{version}")
        self.spark.createDataFrame([(table, version, seq)], "table string, version string, seq long").coalesce(1).write.mode("append").json(f"{self.path}/_current")

    def put(self, table: str, rows: DataFrame, key: str) -> None:
        """Whole rows replaced by key; of equal keys in `rows` the last one stays, in the order of the rows."""
        rows = last_wins(rows.withColumn("__order", F.monotonically_increasing_id()), key, "__order").drop("__order")
        old = self.read(table)
        self.write(table, rows if old is None else old.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True))

    def get(self, table: str, key: str, value) -> DataFrame:
        return self.read(table).where(F.col(key) == value)

    def get_many(self, table: str, key: str, values: list) -> DataFrame:
        return self.read(table).where(F.col(key).isin(*dict.fromkeys(values)))

    def all(self, table: str, key: str) -> DataFrame:
        return self.read(table).orderBy(key)

    def delete_where(self, table: str, condition) -> None:
        """Rows for which the condition isn't true stay, nulls among them."""
        self.write(table, self.read(table).where(~F.coalesce(condition, F.lit(False))))

    def truncate(self, table: str) -> None:
        self.write(table, self.read(table).limit(0))

    def count(self, table: str) -> int:
        rows = self.read(table)
        return 0 if rows is None else rows.count()
