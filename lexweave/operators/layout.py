"""Structure from extractor lines: running lines, headings, ranges, regions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import ship


def placed(elements: DataFrame) -> DataFrame:
    """One row per (doc_sha, page, seq) with a text."""
    rows = elements.where("doc_sha IS NOT NULL AND page IS NOT NULL AND seq IS NOT NULL AND trim(text) <> ''")
    return rows.groupBy("doc_sha", "page", "seq").agg(F.max(F.struct("text", "element_type", "font_size", "bold")).alias("x")).select("doc_sha", "page", "seq", "x.*")


def running(lines: DataFrame, edge: int = 2, pages: int = 2) -> DataFrame:
    """(doc_sha, masked, pages): lines near a page's edge whose text, digits masked, repeats on ``pages`` pages or more."""
    w = Window.partitionBy("doc_sha", "page")
    near = lines.select("*", F.row_number().over(w.orderBy("seq")).alias("t"), F.row_number().over(w.orderBy(F.desc("seq"))).alias("b")).where((F.col("t") <= edge) | (F.col("b") <= edge))
    masked = F.trim(F.regexp_replace(F.lower("text"), "[0-9]+", "#"))
    return near.groupBy("doc_sha", masked.alias("masked")).agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= pages)


def heading_level(lines: DataFrame, id_pattern: str = r"^§+ ?[0-9]+\.[0-9]+") -> DataFrame:
    """Lines with a heading level: 1 + the rank of their font size above the file's usual one; native ids are headings too."""
    usual = lines.where("font_size IS NOT NULL").groupBy("doc_sha", "font_size").agg(F.count("*").alias("n")).groupBy("doc_sha").agg(F.max_by("font_size", F.struct("n", "font_size")).alias("usual"))
    sizes = lines.join(usual, "doc_sha").where("font_size > usual").select("doc_sha", "font_size").distinct()
    rank = sizes.select("doc_sha", "font_size", F.dense_rank().over(Window.partitionBy("doc_sha").orderBy(F.desc("font_size"))).alias("level"))
    native = F.col("text").rlike(id_pattern)
    joined = lines.join(rank, ["doc_sha", "font_size"], "left")
    return joined.withColumn("level", F.when(F.col("level").isNotNull(), F.col("level")).when(native, 1)).select(*lines.columns, F.col("level").cast("int").alias("level"))


def grouped_items(lines: DataFrame, starts: Column) -> DataFrame:
    """(doc_sha, item, first_seq, lines, text): lines cut into items at each line where ``starts`` holds; what stands before
    the first one is item 0."""
    w = Window.partitionBy("doc_sha").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("item", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))
    return numbered.groupBy("doc_sha", "item").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text")
    )


def ranges(headings: DataFrame) -> DataFrame:
    """(doc_sha, seq, level, parent_seq, end_seq): a heading's parent is the last one before it with a smaller level, and it
    covers the lines up to the next one of its level or above.

    Any number of levels: headings stream by in order and only those still open are held. Rows without file, place or level
    are no headings.
    """
    columns = ["doc_sha", "seq", "level", "parent_seq", "end_seq"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, open_ = None, []  # open headings: seq, level, parent
        for pdf in batches:
            out = []
            for d, seq, level in zip(pdf["doc_sha"], pdf["seq"].tolist(), pdf["level"].tolist()):
                if d != doc:
                    out += [(doc, s, k, p, None) for s, k, p in open_]
                    doc, open_ = d, []
                while open_ and open_[-1][1] >= level:
                    out.append((doc, *open_.pop(), seq))
                open_.append((seq, level, open_[-1][0] if open_ else None))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(doc, s, k, p, None) for s, k, p in open_], columns=columns)

    ship(headings.sparkSession)
    rows = headings.where("doc_sha IS NOT NULL AND seq IS NOT NULL AND level IS NOT NULL").select("doc_sha", F.col("seq").cast("int"), F.col("level").cast("int"))
    return rows.repartition("doc_sha").sortWithinPartitions("doc_sha", "seq").mapInPandas(run, "doc_sha string, seq int, level int, parent_seq int, end_seq int")


def lines_from_items(items: DataFrame, tolerance: float = 3.0, gutter: float = 40.0) -> DataFrame:
    """Text items (page, x, y, text) to lines (page, col, y, text): items within ``tolerance`` of a y are one line, a gap
    of ``gutter`` or more starts another column."""
    w = Window.partitionBy("page").orderBy("y", "x")
    rows = items.withColumn("jump", F.col("y") - F.lag("y").over(w)).withColumn("row", F.sum((F.coalesce("jump", F.lit(0.0)) > tolerance).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_row = Window.partitionBy("page", "row").orderBy("x")
    gap = F.col("x") - F.lag("right").over(in_row)
    cols = rows.withColumn("gap", gap).withColumn("col", F.sum((F.coalesce("gap", F.lit(0.0)) >= gutter).cast("int")).over(in_row.rowsBetween(Window.unboundedPreceding, 0)))
    return cols.groupBy("page", "row", "col").agg(F.min("y").alias("y"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda i: i["text"]), " ").alias("text"))
