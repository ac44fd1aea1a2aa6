"""Text functions as column expressions, JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.names import c


def tokens(x: str | Column) -> Column:
    """Lower-case letter and digit runs, in order; null for null."""
    return F.filter(F.split(F.lower(c(x)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def slug(x: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def plain(x: str | Column) -> Column:
    """Markdown links as their text."""
    return F.regexp_replace(c(x), r"\[([^\]]*)\]\(([^)]*)\)", "$1")


def stripped(x: str | Column) -> Column:
    """Without markdown marks at all, white space single."""
    y = F.regexp_replace(plain(x), r"(?m)^#+\s*|[*_`>|]", "")
    return F.trim(F.regexp_replace(y, r"\s+", " "))


def lines(x: str | Column) -> Column:
    return F.split(c(x), r"\r\n|\n|\r")


def words(x: str | Column) -> Column:
    return F.size(F.filter(F.split(c(x), r"\s+"), lambda t: t != ""))


def front_matter(x: str | Column) -> tuple[Column, Column]:
    """(YAML block, body): a leading byte-order mark is skipped; without a block the whole text is the body."""
    pattern = r"(?s)^\x{FEFF}?---\r?\n(.*?)\r?\n---\r?(?:\n|$)(.*)$"
    has = c(x).rlike(pattern)
    return F.when(has, F.regexp_extract(c(x), pattern, 1)), F.when(has, F.regexp_extract(c(x), pattern, 2)).otherwise(c(x))


def id_parts(x: str | Column) -> Column:
    """``UCR:12-40.7`` -> [ucr:12-40.7, 12-40.7, 40.7]."""
    low = F.lower(c(x))
    native = F.when(F.instr(low, ":") > 0, F.regexp_replace(low, "^[^:]*:", "")).otherwise(low)
    last = F.when(F.instr(native, "-") > 0, F.regexp_replace(native, "^[^-]*-", "")).otherwise(native)
    return F.array_distinct(F.filter(F.array(low, native, last), lambda t: t != ""))


def citations(x: str | Column) -> Column:
    """Section numbers cited as ``§ 12.4(b)``: distinct, in order of first mention, without paragraph labels."""
    return F.array_distinct(F.regexp_extract_all(c(x), F.lit(r"§+\s*([0-9]+\.[0-9]+)"), 1))


def links(x: str | Column) -> Column:
    """(text, target, anchor) of markdown links whose target looks like an id."""
    found = F.regexp_extract_all(c(x), F.lit(r"\[[^\]]*\]\([A-Z]+:[^)]*\)"), 0)
    return F.transform(
        found,
        lambda m: F.struct(
            F.regexp_extract(m, r"^\[([^\]]*)\]", 1).alias("text"),
            F.regexp_extract(m, r"\(([^)#]*)", 1).alias("target"),
            F.regexp_extract(m, r"#([^)]*)\)$", 1).alias("anchor"),
        ),
    )


def unhyphenated(x: str | Column) -> Column:
    """``exam-\\nple`` closed, other line ends as blanks."""
    return F.regexp_replace(F.regexp_replace(c(x), r"(\w)-\n([a-z])", "$1$2"), r"\n", " ")


def flat_row(header: Column, row: Column) -> Column:
    return F.array_join(F.zip_with(header, row, lambda h, v: F.concat(h, F.lit(": "), v)), "; ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / greater length; 1 for two empty strings."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def protected(x: str | Column) -> Column:
    """What two readings must agree on: numbers, comparisons, negations."""
    return F.regexp_extract_all(F.lower(c(x)), F.lit(r"[0-9]+(?:[.,][0-9]+)*|[<>≤≥=]|\b(?:not|no|never|except|unless)\b"), 0)


def agrees(a: Column, b: Column, least: float = 0.9) -> Column:
    return (protected(a) == protected(b)) & (similarity(a, b) >= least)


def holds_run(hay: Column, needle: Column) -> Column:
    """The needle's tokens stand in a row within the hay's (both token arrays)."""
    pad = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return F.contains(pad(hay), pad(needle))


def degenerate(x: str | Column) -> Column:
    """Output of a transcriber that got stuck: 20 lines or more, one of them 8 times, under half of them distinct."""
    full = F.filter(F.transform(lines(x), lambda t: F.trim(t)), lambda t: t != "")
    most = F.array_max(F.transform(F.array_distinct(full), lambda t: F.size(F.filter(full, lambda u: u == t))))
    return F.coalesce((F.size(full) >= 20) & (most >= 8) & (F.size(F.array_distinct(full)) / F.size(full) < 0.5), F.lit(False))


def usable_second(first: Column, second: Column) -> Column:
    """A second reading counts if it has half to one and a half times the words of the first."""
    ratio = words(second) / F.nullif(words(first), F.lit(0))
    return F.coalesce(ratio.between(0.5, 1.5), F.lit(False))
