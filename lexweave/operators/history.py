"""Problem 6: history of changing attributes, from snapshots sorted by entity and time.

Deliveries are first reduced to one per (entity, day), which bounds an entity's rows by the days of the calendar, so no
entity can fill a task. They are then hash-partitioned by entity and sorted by (entity, time): Spark's sort merges the
sorted runs of all snapshots into one iterator per partition, and a single pass over it closes each version as the
next one comes. Only the last row and the open version are held between Arrow batches; payloads travel as digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import names
from lexweave.session import ship
from lexweave.operators.integrity import deliveries

#: Days since 1970 that stand for "since ever" and "still".
EVER, STILL = -(2**31), 2**31 - 1


def digest(*cols: str | Column) -> Column:
    """Digest of several columns, in which null differs from ''."""
    parts = [F.coalesce(F.concat(F.lit("="), names.c(x).cast("string")), F.lit("0")) for x in cols]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None  # the row whose successor is not known yet
    open_ = None  # the version that may still go on: (id, start, end, digest)
    for pdf in batches:
        if pdf.empty:
            continue
        if last is not None:
            pdf = pd.concat([last, pdf], ignore_index=True)
        last = pdf.iloc[-1:]
        if len(pdf) > 1:
            out, open_ = _close(pdf, pdf.iloc[:-1], open_)
            if len(out):
                yield out
    if last is not None:
        out, open_ = _close(last, last, open_)
        if len(out):
            yield out
    if open_ is not None:
        yield pd.DataFrame([open_[:3]], columns=["id", "valid_from", "valid_to"])


def _close(rows: pd.DataFrame, heads: pd.DataFrame, open_: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
    """Closed versions of ``heads``; the row after each head is found in ``rows``."""
    ids, start, limit, payload = (heads[x].to_numpy() for x in ("id", "start", "limit", "digest"))
    end = limit.copy()
    if len(rows) > len(heads):
        after = rows["start"].to_numpy()[1:]
        same = rows["id"].to_numpy()[1:] == ids
        end = np.where(same, np.minimum(limit, after), limit)
    keep = end > start
    ids, start, end, payload = ids[keep], start[keep], end[keep], payload[keep]
    if open_ is not None:
        ids, start, end, payload = (np.concatenate([np.array([o], dtype=x.dtype), x]) for o, x in zip(open_, (ids, start, end, payload)))
    if not len(ids):
        return pd.DataFrame({"id": [], "valid_from": [], "valid_to": []}), None
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (end[:-1] != start[1:]) | (payload[1:] != payload[:-1])
    at = np.flatnonzero(first)
    ends = np.append(at[1:] - 1, len(ids) - 1)
    out = pd.DataFrame({"id": ids[at], "valid_from": start[at], "valid_to": end[ends]})
    tail = (out["id"].iloc[-1], out["valid_from"].iloc[-1], out["valid_to"].iloc[-1], payload[-1])
    return out.iloc[:-1], tail


def history(versions: DataFrame) -> DataFrame:
    """(id, valid_from, valid_to) from ``versions`` (id, start, limit, digest): days as bigint, start unique per id.

    A version ends at the start of the next or at its own ``limit``. Empty periods fall away; then a version that starts
    where the one before it ends, with an equal digest, continues it.
    """
    ship(versions.sparkSession)
    days = (
        versions.repartition("id")
        .sortWithinPartitions("id", "start")
        .mapInPandas(_merge, "id string, valid_from bigint, valid_to bigint")
    )
    day = lambda x, none: F.when(F.col(x) == none, "").otherwise(F.date_format(F.date_from_unix_date(F.col(x).cast("int")), "yyyy-MM-dd"))
    return days.select("id", day("valid_from", EVER).alias("valid_from"), day("valid_to", STILL).alias("valid_to"))


def section_history(sections: DataFrame) -> DataFrame:
    """History of every work: a version runs from its effective ('' if undated) to the earliest of the next version's
    effective, its retirement, and the date in its superseded_by (if later than its effective, or it is undated).
    """
    day = lambda x: F.unix_date(x).cast("bigint")
    versions = deliveries(sections, "retired", "superseded_by", digest("title", "body").alias("digest"))
    by = names.version_date("superseded_by")
    successor = F.when(F.col("effective").isNull() | (by > F.col("effective")), day(by))
    return history(
        versions.select(
            "id",
            F.coalesce(day(F.col("effective")), F.lit(EVER)).cast("bigint").alias("start"),
            F.least(F.coalesce(day(F.col("retired").cast("date")), F.lit(STILL)), F.coalesce(successor, F.lit(STILL))).cast("bigint").alias("limit"),
            "digest",
        )
    )
