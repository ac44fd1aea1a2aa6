"""Problem 1: a change feed applied as keyed streaming state of its actions and of their paragraphs.

Both states are order-free (accepting a change twice, late or out of order gives the same result) and are emitted as
idempotent upserts, one output directory per micro-batch (``Upserts``), compacted when there are many:

* per *action*: payload and last sequence ``(revision, received_at, feed_pos)`` in Spark's state store, partially
  aggregated before its shuffle; only a newer sequence replaces it. An action whose newest revision can do nothing (no
  date, no work) stays as a tombstone, so an older revision that comes late cannot revive it.
* per *paragraph*: payload (the action that gave its text), sequence (the batch) and tombstone. Each micro-batch takes
  the works its accepted changes touch, before or after the change, and sets their paragraphs anew from the current
  actions; a paragraph that is there no longer gets a tombstone. Works without changes are neither read nor written.

Within a work a paragraph has the sequences of its last payload, last ``add`` and last removal. It exists if its last
``add`` is newer than its removal, so three maxima are enough and a hot work is split over its paragraphs, pre-aggregated
before the shuffle. A redesignation ties two paragraphs together. The timeline of each paragraph so touched is cut at its
redesignations; what lies between two cuts is pre-aggregated to at most one effect (set, clear, amend-if-there),
and only those effects and the redesignations are folded in order, streaming, per work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.session import fs_of, new_path, ship, staged
from lexweave.streaming.upserts import Upserts

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ACTION_COLUMNS = ["action_id", "target_id", "target_anchor", "kind", "effective", "text", "revision", "received_at", "feed_pos"]


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or directory as a stream. A file source wants a directory: for one file, that of its folder with all
    other names filtered out."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    fs, p = fs_of(spark, path)
    if not fs.getFileStatus(p).isFile():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", re.sub(r"([\\*?\[\]{}^])", r"\\\1", p.getName())).parquet(p.getParent().toString())


def own_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose settings are its own, with state stores on local disk and changelogs in the
    checkpoint, so that a feed of any size fits; a provider the session chose itself is kept."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    chosen = own.conf.get(STATE_STORE)
    own.conf.set(STATE_STORE, chosen.replace("HDFSBackedStateStoreProvider", "RocksDBStateStoreProvider"))
    return own


def latest_actions(feed: DataFrame, with_text: bool = False) -> DataFrame:
    """Keyed state of the feed: one row per action with the payload of its highest sequence.

    Works on a batch and on a stream. Ties of revision go to the later receipt, then the later feed position.
    Without ``with_text`` only a redesignation's text (its new anchor) is kept in the state.
    """
    kind = names.action_kind("kind")
    payload = [
        names.plain_work("target_id").alias("work"),
        names.plain_anchor("target_anchor").alias("anchor"),
        kind.alias("kind"),
        F.col("effective").cast("date").alias("effective"),
        F.when(kind == "redesignate", names.plain_anchor("text")).alias("new_anchor"),
    ]
    if with_text:
        payload.append(F.col("text").alias("text"))
    sequence = F.struct(F.col("revision"), F.col("received_at"), F.col("feed_pos"))
    return (
        feed.select(names.plain_action("action_id").alias("action_id"), F.struct(*payload).alias("payload"), sequence.alias("sequence"))
        .where(F.col("action_id").isNotNull())
        .groupBy("action_id")
        .agg(F.max_by("payload", "sequence").alias("payload"), F.max("sequence").alias("sequence"))
    )


def action_state(spark: SparkSession, base: str) -> Upserts:
    return Upserts(spark, f"{base}/actions", ["action_id"])


def paragraph_state(spark: SparkSession, base: str) -> Upserts:
    return Upserts(spark, f"{base}/paragraphs", ["target_id", "target_anchor"])


def apply_stream(feed: DataFrame, base: str, with_text: bool = False, compact_after: int = 20) -> DataFrame:
    """Run the keyed states over a streaming ``feed`` to its present end; the paragraphs that exist then.

    ``base`` is a lasting folder of the shared file system: upserts of actions and paragraphs by micro-batch, and the
    checkpoint. A batch that is repeated after a failure writes the same directories again, so a restart neither loses nor
    doubles anything. After ``compact_after`` batches the upserts are merged.
    """
    spark = feed.sparkSession
    actions, paragraphs = action_state(spark, base), paragraph_state(spark, base)

    def publish(accepted: DataFrame, batch: int) -> None:
        known, there = actions.current(before=batch), paragraphs.current(before=batch)
        tombstone = F.col("payload.effective").isNull() | F.col("payload.work").isNull()
        actions.write(accepted.select("action_id", "payload.*", tombstone.alias("tombstone"), "sequence"), batch)
        now = actions.current(before=batch + 1)
        if known is not None:  # only the works that accepted changes touch, where they are and where they were
            changed = spark.read.parquet(f"{actions.root}/batch={batch}")
            works = changed.select("work").unionByName(known.join(changed.select("action_id"), "action_id", "left_semi").select("work")).where("work IS NOT NULL").distinct()
            now = now.join(works, "work", "left_semi")
        live = current_paragraphs(now).select("target_id", "target_anchor", "action_id", F.lit(False).alias("tombstone"), F.lit(batch).cast("bigint").alias("sequence"))
        if there is not None:
            live = staged(live, "paragraphs")
            of_works = there.where("NOT tombstone").join(works.select(F.col("work").alias("target_id")), "target_id", "left_semi")
            gone = of_works.join(live.select("target_id", "target_anchor"), ["target_id", "target_anchor"], "left_anti")
            live = live.unionByName(gone.withColumn("tombstone", F.lit(True)).withColumn("sequence", F.lit(batch).cast("bigint")))
        paragraphs.write(live, batch)

    query = latest_actions(feed, with_text).writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    for state in (actions, paragraphs):
        if len(state._live()) > compact_after:
            state.compact()
    found = paragraphs.current()
    if found is None:
        return spark.createDataFrame([], FOLD_SCHEMA)
    return found.where("NOT tombstone").select("target_id", "target_anchor", "action_id")


def _registers(df: DataFrame, keys: list[str]) -> DataFrame:
    """The paragraph state per key: last add, tombstone, last payload; mergeable in any order."""
    when = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("seq"))
    return df.groupBy(*keys).agg(
        F.max(when("add")).alias("add_seq"),
        F.max(when("remove")).alias("gone_seq"),
        F.max(when("add", "amend")).alias("payload_seq"),
        F.max("seq").alias("last_seq"),
    )


def _newer(a: Column, b: Column) -> Column:
    return a.isNotNull() & (b.isNull() | (a > b))


FOLD_SCHEMA = "target_id string, target_anchor string, action_id string"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Effects sorted by work and sequence, folded with only the current work's paragraphs in memory."""
    work, state, out = None, {}, []
    for batch in batches:
        for w, op, anchor, other, action in zip(batch["work"], batch["op"], batch["anchor"], batch["new_anchor"], batch["action_id"]):
            if w != work:
                out += [(work, a, x) for a, x in state.items()]
                work, state = w, {}
            if op == "move":
                if anchor in state:
                    state[other] = state.pop(anchor)
            elif op == "clear":
                state.pop(anchor, None)
            elif op == "set" or anchor in state:
                state[anchor] = action
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["target_id", "target_anchor", "action_id"])
            out = []
    out += [(work, a, x) for a, x in state.items()]
    yield pd.DataFrame(out, columns=["target_id", "target_anchor", "action_id"])


def current_paragraphs(actions: DataFrame) -> DataFrame:
    """Paragraphs (target_id, target_anchor, action_id) that exist after all ``actions`` of ``latest_actions``.

    Actions without an effective date, and of no named work, do nothing. ``remove`` with a null anchor takes the
    whole work away: only what is newer counts. A redesignation of the null anchor, or to no anchor, does nothing.
    """
    a = (
        actions.where(F.col("effective").isNotNull() & F.col("work").isNotNull() & (F.col("kind") != "stay"))
        .withColumn("seq", names.action_order(F.col("action_id"), F.col("effective")))
        .select("work", "anchor", "kind", "new_anchor", "seq")
    )
    ship(actions.sparkSession)
    a = staged(a, "actions")
    wipes = a.where((F.col("kind") == "remove") & (F.col("anchor") == "")).groupBy("work").agg(F.max("seq").alias("wipe_seq"))
    # What precedes the removal of the whole work has no effect.
    alive = lambda df: df.join(wipes, "work", "left").where(F.col("wipe_seq").isNull() | (F.col("seq") > F.col("wipe_seq"))).drop("wipe_seq")
    moves = alive(a.where((F.col("kind") == "redesignate") & (F.col("anchor") != "") & (F.col("new_anchor") != "") & (F.col("anchor") != F.col("new_anchor"))))
    touched = (
        moves.select("work", F.explode(F.array("anchor", "new_anchor")).alias("anchor")).distinct()
    )
    plain = a.where(F.col("kind") != "redesignate")

    # Every paragraph without the touched ones: registers only.
    state = _registers(plain, ["work", "anchor"]).join(touched, ["work", "anchor"], "left_anti").join(wipes, "work", "left")
    still = (
        state.where(_newer(F.col("add_seq"), F.col("gone_seq")) & _newer(F.col("add_seq"), F.col("wipe_seq")))
        .select(F.col("work").alias("target_id"), F.col("anchor").alias("target_anchor"), F.col("payload_seq.a").alias("action_id"))
    )

    # The touched ones: timelines cut at the redesignations, one effect per piece.
    cuts = moves.select("work", F.explode(F.array("anchor", "new_anchor")).alias("anchor"), F.lit("cut").alias("kind"), "seq")
    timeline = alive(plain.join(touched, ["work", "anchor"], "left_semi")).select("work", "anchor", "kind", "seq").unionByName(cuts)
    order = Window.partitionBy("work", "anchor").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    pieces = _registers(
        timeline.withColumn("piece", F.sum((F.col("kind") == "cut").cast("long")).over(order)).where(F.col("kind") != "cut"),
        ["work", "anchor", "piece"],
    )
    op = (
        F.when(_newer(F.col("add_seq"), F.col("gone_seq")), "set")
        .when(F.col("gone_seq").isNotNull(), "clear")
        .when(F.col("payload_seq").isNotNull(), "amend")
    )
    effects = pieces.select("work", F.col("last_seq").alias("seq"), op.alias("op"), "anchor", F.lit(None).cast("string").alias("new_anchor"), F.col("payload_seq.a").alias("action_id"))
    steps = (
        effects.unionByName(moves.select("work", "seq", F.lit("move").alias("op"), "anchor", "new_anchor", F.lit(None).cast("string").alias("action_id")))
    )
    moved = (
        steps.select("work", "seq", "op", "anchor", "new_anchor", "action_id")
        .repartition("work")
        .sortWithinPartitions("work", "seq")
        .drop("seq")
        .mapInPandas(_fold, FOLD_SCHEMA)
        .where(F.col("target_id").isNotNull())
    )
    return still.unionByName(moved)


def with_text(paragraphs: DataFrame, actions: DataFrame) -> DataFrame:
    """The paragraphs with the text their action gave them (``actions`` from ``latest_actions(with_text=True)``)."""
    return paragraphs.join(actions.select("action_id", "text"), "action_id", "left")


def rebuild(spark: SparkSession, path: str, state_dir: str | None = None) -> DataFrame:
    """Stream the feed at ``path`` through the keyed states and return its current paragraphs.

    With a lasting ``state_dir`` the next call goes on where this one stopped.
    """
    own = own_session(spark)
    return apply_stream(stream_of(own, path).select(*ACTION_COLUMNS), state_dir or new_path(spark, "feed"))
