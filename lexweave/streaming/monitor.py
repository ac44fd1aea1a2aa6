"""Streaming views of a change feed: rates in event time with late data, and layers kept fresh batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.session import staged
from lexweave.streaming.upserts import Upserts


def change_rates(feed: DataFrame, width: str = "1 day", delay: str = "60 days") -> DataFrame:
    """(start, kind, n) of a streaming feed: arrivals per window and verb; rows later than ``delay`` behind the newest are
    left out, and a window is final once the watermark has passed it."""
    w = feed.withWatermark("received_at", delay).groupBy(F.window("received_at", width).alias("w"), names.action_kind("kind").alias("kind"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def run_to_files(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there now and end; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def keep_fresh(files: DataFrame, layer: Upserts, digest: str, build: Callable[[DataFrame], DataFrame], checkpoint: str, deleted: str | None = None) -> None:
    """Fold a stream of file states (key, digest, sequence, inputs) into a layer of built rows, micro-batch by micro-batch.

    Of several states of a key the greatest sequence counts, and one that is older than what the layer holds changes
    nothing. A key is only built when its digest changes; where ``deleted`` is true it gets a tombstone. Each batch
    writes its own upserts, not the layer. ``build`` maps input rows to built rows with key and digest, one per key.
    """
    key, seq = layer.key, layer.sequence

    def one(batch: DataFrame, n: int) -> None:
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        rows = batch.withColumn("_gone", gone)
        rest = [c for c in rows.columns if c not in key]
        newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*key, *(F.col("_r")[c].alias(c) for c in rest))
        held = layer.current(before=n)
        if held is not None:
            old = held.select(*key, F.col(seq).alias("_seq"), F.when(~F.col("tombstone"), F.col(digest)).alias("_digest"))
            newest = newest.join(old, key, "left").where(F.col("_seq").isNull() | (F.col(seq) > F.col("_seq")))
            same = ~F.col("_gone") & F.coalesce(F.col("_digest") == F.col(digest), F.lit(False))
        else:
            same = F.lit(False)
        newest = staged(newest.withColumn("_same", same), "states")
        todo = newest.where("NOT _gone AND NOT _same")
        built = build(todo.drop("_gone", "_same", "_seq", "_digest")).drop(seq).join(todo.select(*key, seq), key).withColumn("tombstone", F.lit(False))
        dead = newest.where("_gone").select(*key, seq, F.lit(True).alias("tombstone"))
        out = built.unionByName(dead, allowMissingColumns=True)
        if held is not None:
            out = out.unionByName(held.drop(seq).join(newest.where("_same").select(*key, seq), key).select(*out.columns))
        layer.write(out, n)

    files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fresh_rows(layer: Upserts) -> DataFrame | None:
    """The layer's rows that are not deleted."""
    rows = layer.current()
    return None if rows is None else rows.where("NOT tombstone").drop("tombstone")
