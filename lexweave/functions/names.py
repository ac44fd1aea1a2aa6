"""Ids, anchors and verbs of the rule corpus as column expressions (all JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space in Java's pattern language.
BLANK = r"\p{IsWhite_Space}"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: str | Column) -> Column:
    """Without outer Unicode blanks; null if nothing is left."""
    t = F.regexp_replace(c(x), rf"^{BLANK}+|{BLANK}+$", "")
    return F.when(t != "", t)


def _caps_prefix(x: Column) -> Column:
    """The part before the first colon in capitals."""
    at = F.instr(x, ":")
    return F.when(at > 0, F.concat(F.upper(F.substring_index(x, ":", 1)), F.substr(x, at))).otherwise(x)


def plain_work(x: str | Column) -> Column:
    """Plain id of the work that ``x`` names: no blanks, version or anchor, prefix in capitals; null for nothing."""
    return _caps_prefix(trimmed(F.regexp_replace(c(x), r"[@#].*$", "")))


def plain_action(x: str | Column) -> Column:
    """Plain id of the action that ``x`` names; null for nothing."""
    return _caps_prefix(trimmed(x))


def plain_anchor(x: str | Column) -> Column:
    """``#a-1``, ``(a)(1)`` and ``a-1`` are one anchor; '' for null or empty."""
    bare = F.regexp_replace(F.coalesce(c(x), F.lit("")), rf"{BLANK}|^{BLANK}*#", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[()]+", "-"), r"^-+|-+$", "")


def expression_id(work: Column, effective: Column) -> Column:
    return F.when(effective.isNull(), work).otherwise(F.concat(work, F.lit("@"), F.date_format(effective, "yyyy-MM-dd")))


def action_kind(x: str | Column) -> Column:
    """add, amend, remove, redesignate or stay. An unknown verb amends; no verb changes nothing (stay)."""
    k = F.lower(trimmed(x))
    return (
        F.when(k.isNull(), "stay")
        .when(k.rlike("redesignat"), "redesignate")
        .when(k.rlike("remov|delet"), "remove")
        .when(k.rlike("^add"), "add")
        .when(k.rlike("stay|suspend"), "stay")
        .otherwise("amend")
    )


def action_order(action_id: Column, effective: Column) -> Column:
    """Sort key of an action: effective, year and number of the notice, number of the instruction, id.

    Parts that are not numbers sort first.
    """
    part = lambda i: F.regexp_extract(action_id, r"(\d+)-(\d+)#\D*(\d+)\s*$", i).try_cast("bigint")
    return F.struct(effective.alias("d"), part(1).alias("y"), part(2).alias("n"), part(3).alias("i"), action_id.alias("a"))


def version_date(x: str | Column) -> Column:
    """The date in ``work@YYYY-MM-DD``; null if there is none."""
    return F.try_to_date(F.regexp_extract(c(x), r"@(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def tidy_path(x: str | Column) -> Column:
    """A path with forward slashes and no leading ``./``; null for nothing."""
    return trimmed(F.regexp_replace(F.replace(trimmed(x), F.lit("\\"), F.lit("/")), r"^(\./+)+", ""))


def month_of(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM"), F.lit(""))


def day_of(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(""))
