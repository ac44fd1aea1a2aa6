"""Keyed state as a log of upserts: one directory per micro-batch above a compacted base, all on the shared file system.

A repeated batch overwrites its own directory, and rows merge by their sequence, so writing twice, out of order or after a
restart gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import fs_of, remove


class Upserts:
    """State keyed by ``key``; of several rows of a key the one with the greatest ``sequence`` column counts."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], sequence: str = "sequence"):
        self.spark, self.root, self.key, self.sequence = spark, root.rstrip("/"), key, sequence

    def _parts(self, kind: str) -> list[int]:
        fs, p = fs_of(self.spark, self.root)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        ready = [n for n in names if n.startswith(f"{kind}=") and fs.exists(fs_of(self.spark, f"{self.root}/{n}/_SUCCESS")[1])]
        return sorted(int(n.partition("=")[2]) for n in ready)

    def _live(self) -> list[str]:
        """The newest finished base and the finished batches above it."""
        base = self._parts("base")[-1:]
        return [f"base={b}" for b in base] + [f"batch={b}" for b in self._parts("batch") if not base or b > base[0]]

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def current(self, before: int | None = None) -> DataFrame | None:
        """One row per key, its newest; None while there is nothing. With ``before`` later batches are left out."""
        parts = [p for p in self._live() if before is None or not p.startswith("batch=") or int(p[6:]) < before]
        if not parts:
            return None
        rows = self.spark.read.parquet(*(f"{self.root}/{p}" for p in parts))
        if len(parts) == 1:
            return rows
        rest = [c for c in rows.columns if c not in self.key]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), self.sequence).alias("_row")).select(*self.key, *(F.col("_row")[c].alias(c) for c in rest)).select(*rows.columns)

    def compact(self) -> None:
        """Merge base and batches into a new base; readers see the old parts until it is finished, then only the new one."""
        batches = self._parts("batch")
        if not batches:
            return
        old = self._live()
        if len(old) > 1:
            self.current().write.mode("overwrite").parquet(f"{self.root}/base={batches[-1]}")
            for part in old:
                remove(self.spark, f"{self.root}/{part}")
