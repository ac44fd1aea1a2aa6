"""Problem 2: processing only new or changed records, with the target as the only state.

Every published row carries its source key and version. A run anti-joins its source against the rows of the target
version in force; what remains is new or changed. The outputs are written before the next version is published, by making
its pointer with compare-and-set, so a run that dies leaves the last version in force and is simply repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.session import fs_of, new_path, put_if_absent, read_text, remove


def unprocessed(source: DataFrame, state: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of ``source`` whose (key, version) is not in ``state``; a null version never counts as processed."""
    return source.join(state.select(*key, version).where(F.col(version).isNotNull()), [*key, version], "left_anti")


class Conflict(RuntimeError):
    """Another run has published since this one read the target; nothing was published, the run is to be repeated."""


class VersionedTarget:
    """Immutable versions of an output table and, in order, the pointers that publish them.

    The table is its own state: every row carries the source key and the version of the record it came from. A run reads the
    published version, processes what is not in it, writes the next version whole, and only then publishes it, by making
    the next pointer with its content at once. Readers see all of a run or nothing; a run that dies at any point before
    leaves the last version in force and is simply repeated; of two runs that started from one version one is refused.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], version: str):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version

    def pointers(self) -> list[int]:
        """Published orders, the last one in force."""
        fs, p = fs_of(self.spark, f"{self.path}/_published")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def current(self, order: int | None = None) -> DataFrame | None:
        """The version in force (or the one published as ``order``); None before the first."""
        done = self.pointers() if order is None else [order]
        return self.spark.read.parquet(f"{self.path}/{read_text(self.spark, self._pointer(done[-1]))}") if done else None

    def _pointer(self, order: int) -> str:
        return f"{self.path}/_published/{order:012d}"

    def publish(self, table: DataFrame, after: int | None) -> int:
        """Write ``table`` and publish it as the successor of pointer ``after`` (None: the first); its order."""
        name = f"v-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/{name}")
        order = 0 if after is None else after + 1
        if not put_if_absent(self.spark, self._pointer(order), name):
            remove(self.spark, f"{self.path}/{name}")
            raise Conflict(f"version {order} of {self.path} was published by another run")
        return order

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame] = lambda fresh: fresh, complete: bool = False) -> int:
        """Process the new and changed records of ``source`` and publish the table they belong to.

        ``process`` maps records to output rows, any number each, and keeps key and version. Rows of a key that comes with
        another version are replaced; keys that the source does not deliver stay, unless it is ``complete``. A record that
        gives no row is processed again by the next run. A null version never counts as processed.
        """
        done = self.pointers()
        state = self.current(done[-1]) if done else None
        out = process(source if state is None else unprocessed(source, state, self.key, self.version))
        if state is not None:
            stays = state.join(source.select(*self.key, self.version), [*self.key, self.version], "left_semi")
            if not complete:
                stays = stays.unionByName(state.join(source.select(*self.key), self.key, "left_anti"))
            out = out.select(*state.columns).unionByName(stays.select(*state.columns))
        return self.publish(out, done[-1] if done else None)

    def changes(self, order: int) -> DataFrame:
        """Rows that the version published as ``order`` has and the one before it has not."""
        before = [o for o in self.pointers() if o < order]
        now = self.current(order)
        return now if not before else unprocessed(now, self.current(before[-1]), self.key, self.version)

    def prune(self, keep: int = 2) -> None:
        """Drop all but the last ``keep`` versions, and what died before it was published and is not being written now."""
        for order in self.pointers()[:-keep]:
            remove(self.spark, f"{self.path}/{read_text(self.spark, self._pointer(order))}")
            remove(self.spark, self._pointer(order))


def listings(fingerprints: DataFrame) -> DataFrame:
    """One row per (run_id, rel_path): the latest listing, with a tidy path and the hash in small letters.

    Ties of listed_at go to the greater hash. A listing whose hash is null counts as not listed, as does one
    without a run or a path.
    """
    one = F.max_by(names.trimmed(F.lower("blake3")), F.struct(F.col("listed_at"), names.trimmed(F.lower("blake3"))))
    return (
        fingerprints.select("run_id", names.tidy_path("rel_path").alias("rel_path"), "blake3", "listed_at")
        .where(F.col("run_id").isNotNull() & F.col("rel_path").isNotNull())
        .groupBy("run_id", "rel_path")
        .agg(one.alias("version"))
        .where(F.col("version").isNotNull())
    )


def baselines(runs: DataFrame) -> DataFrame:
    """(run_id, base_id): the latest run that started earlier and ended well; null if there is none.

    The log has a few rows per run; it is small by nature, but is only ever windowed, never collected.
    """
    one = runs.groupBy("run_id").agg(F.min("started_at").alias("started_at"), F.max(F.lower(names.trimmed("state")) == "ok").alias("ok"))
    ok = one.where("ok").select("started_at", F.col("run_id").alias("ok_id"))
    both = one.select("run_id", "started_at", F.lit(1).alias("side"), F.lit(None).cast(ok.schema["ok_id"].dataType).alias("ok_id")).unionByName(
        ok.select(F.lit(None).cast(one.schema["run_id"].dataType).alias("run_id"), "started_at", F.lit(2).alias("side"), "ok_id")
    )
    before = Window.orderBy("started_at", "side", "ok_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("base_id", F.last("ok_id", ignorenulls=True).over(before)).where("side = 1").select("run_id", "base_id")


def replay(target: VersionedTarget, listed: DataFrame, runs: DataFrame) -> DataFrame:
    """Every run of the log against the version of ``target`` that was in force when it started: its new and changed rows.

    What all runs list is written once; then each run that ended well publishes its part, in the order of the log (a few
    rows, one pointer a run), and no other part ever becomes a version. All runs meet their versions in one anti-join.
    """
    name = f"v-{uuid.uuid4().hex}"
    listed.write.parquet(f"{target.path}/{name}")
    data = target.spark.read.schema(listed.schema).parquet(f"{target.path}/{name}")
    good = runs.groupBy("run_id").agg(F.min("started_at").alias("at"), F.max(F.lower(names.trimmed("state")) == "ok").alias("ok")).where("ok AND run_id IS NOT NULL AND at IS NOT NULL")
    for order, r in enumerate(good.orderBy("at", "run_id").toLocalIterator()):
        if not put_if_absent(target.spark, target._pointer(order), f"{name}#{r.run_id}"):
            raise Conflict(f"version {order} of {target.path} was published by another run")
    published = [int(read_text(target.spark, target._pointer(o)).partition("#")[2]) for o in target.pointers()]
    state = data.where(F.col("run_id").isin(published)).select(F.col("run_id").alias("base_id"), *target.key, target.version)
    return unprocessed(data.join(baselines(runs), "run_id", "left"), state, ["base_id", *target.key], target.version)


def changed_since_last_good(fingerprints: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, rel_path) new or changed in every run since the last good run before it, whatever lay between.

    Runs missing from the log are measured against nothing (they list only new files).
    """
    spark = fingerprints.sparkSession
    target = VersionedTarget(spark, new_path(spark, "listing"), ["rel_path"], "version")
    return replay(target, listings(fingerprints), runs).select("run_id", "rel_path")
