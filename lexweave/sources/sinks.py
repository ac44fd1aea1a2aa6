"""Layer files and generations."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import fs_of


def write_layers(layers: dict[str, DataFrame], folder: str, formats: dict[str, str] | None = None) -> None:
    """Each layer to its own directory: Parquet, or what ``formats`` says (json for JSON lines)."""
    for name, df in layers.items():
        df.write.mode("overwrite").format((formats or {}).get(name, "parquet")).save(f"{folder}/{name}")


class Generations:
    """Immutable generations of an index below one folder; the newest with a ready mark is what readers see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _ready(self) -> list[str]:
        fs, p = fs_of(self.spark, self.root)
        if not fs.exists(p):
            return []
        out = []
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("generation=") and fs.exists(fs_of(self.spark, f"{self.root}/{name}/_ready")[1]):
                out.append(name)
        return sorted(out)

    def newest(self) -> str | None:
        done = self._ready()
        return f"{self.root}/{done[-1]}" if done else None

    def read(self, layer: str) -> DataFrame | None:
        at = self.newest()
        return self.spark.read.parquet(f"{at}/{layer}") if at else None

    def publish(self, layers: dict[str, DataFrame]) -> str:
        """Write all layers, then the ready mark: a run that dies before it is never seen."""
        at = f"{self.root}/generation={time.time_ns():020d}"
        write_layers(layers, at)
        fs, mark = fs_of(self.spark, f"{at}/_ready")
        fs.create(mark, False).close()
        return at

    def withdraw(self) -> str | None:
        """Take the newest generation back; the one before it is in force again."""
        at = self.newest()
        if at:
            fs, mark = fs_of(self.spark, f"{at}/_ready")
            fs.delete(mark, False)
        return self.newest()

    def prune(self, keep: int = 2) -> None:
        fs, _ = fs_of(self.spark, self.root)
        for name in self._ready()[:-keep] if keep else []:
            fs.delete(fs_of(self.spark, f"{self.root}/{name}")[1], True)


def refreshed(old: DataFrame, new: DataFrame, key: str, digest: str, build) -> tuple[DataFrame, DataFrame]:
    """(layer, rebuilt keys): rows of ``old`` whose key and digest are still in ``new`` are kept, the others are built anew.

    ``old`` (key, digest, ...built columns), ``new`` (key, digest, ...inputs); ``build`` maps input rows to built rows with key
    and digest. Rows of vanished keys fall away; equal inputs are never built twice.
    """
    kept = old.join(new.select(key, digest), [key, digest], "left_semi")
    todo = new.join(old.select(key, digest), [key, digest], "left_anti")
    return kept.unionByName(build(todo).select(*kept.columns)), todo.select(key)


def unchanged(old: DataFrame, new: DataFrame, key: str, digest: str) -> bool:
    """No key was added, removed or changed."""
    a, b = old.select(key, digest), new.select(key, digest)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def total_bytes(files: DataFrame, text: str) -> int:
    """Bytes of all texts, by which a gram index is worth its while or not."""
    return files.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
