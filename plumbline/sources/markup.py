"""Scans that turn markup, pipe tables and files into rows, and the sink for partitioned reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def elements(pages: DataFrame, key: str, body: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """One row for each match of pattern in a document, with its ordinal and its capture groups; only &amp; is unescaped."""
    m = pages.select(key, F.posexplode(F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).alias("pos", "_m"))
    return m.select(key, "pos", *(F.replace(F.regexp_extract("_m", pattern, i + 1), F.lit("&amp;"), F.lit("&")).alias(n) for i, n in enumerate(names)))


def positioned_words(docs: DataFrame, key: str, body: str) -> DataFrame:
    """The words of markup documents: key, page, pos, text, x0, y0, x1, y1 and problem.

    A document holds page elements, whose ordinal from 1 is the page (sheets share their coordinates, so nothing may be
    compared across pages), and word elements in them with a box in their attributes; without page markup all of it is page
    1, and what lies outside of pages has none. Only &amp; is unescaped; words without text are left out. A box that is
    no number is null and told as the problem. Null bodies have no words.
    """
    pages = F.regexp_extract_all(body, F.lit(r"(?s)<page\b[^>]*>(.*?)</page>"), F.lit(1))
    sheets = F.when(F.size(pages) > 0, pages).otherwise(F.array(body))
    sheet = docs.filter(F.col(body).isNotNull()).select(key, F.posexplode(sheets).alias("page", "_b"))
    box = ("x0", "y0", "x1", "y1")
    pattern = r'(?s)<word xMin="([^"]*)" yMin="([^"]*)" xMax="([^"]*)" yMax="([^"]*)">(.*?)</word>'
    each = sheet.select(key, (F.col("page") + 1).alias("page"), F.posexplode(F.regexp_extract_all("_b", F.lit(pattern), F.lit(0))).alias("pos", "_m"))
    text = F.trim(F.regexp_replace(F.replace(F.regexp_extract("_m", pattern, 5), F.lit("&amp;"), F.lit("&")), r"^\s+|\s+$", ""))
    out = each.select(key, "page", "pos", text.alias("text"), *(F.regexp_extract("_m", pattern, i + 1).try_cast("double").alias(c) for i, c in enumerate(box)))
    bad = F.when(F.col("x0").isNull() | F.col("y0").isNull() | F.col("x1").isNull() | F.col("y1").isNull(), "box is no number")
    return out.filter("text <> ''").withColumn("problem", bad)


def pipe_rows(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Rows of pipe tables: id (first cell), arity, and the problem if the id is empty or was given before."""
    cells = F.transform(F.split(line, r"\|", -1), lambda c: F.trim(c))
    rows = lines.select(key, order, cells.alias("_c")).withColumn("id", F.col("_c")[0])
    before = F.row_number().over(Window.partitionBy(key, "id").orderBy(order)) > 1
    problem = F.when(F.col("id") == "", "empty id").when(before, "duplicate id")
    return rows.withColumn("problem", problem).select(key, order, "id", F.size("_c").alias("arity"), "problem")


def row_cells(line: Column) -> Column:
    """The trimmed cells of a table row. Blank outer cells go once on each side, so that an empty last column stays."""
    cells = F.transform(F.split(line, r"\|", -1), lambda c: F.trim(c))
    cells = F.when(F.get(cells, F.lit(0)) == "", F.slice(cells, 2, F.size(cells))).otherwise(cells)
    return F.when(F.try_element_at(cells, F.lit(-1)) == "", F.slice(cells, 1, F.size(cells) - 1)).otherwise(cells)


def pipe_tables(lines: DataFrame, key: str, order: str, line: str, header: Sequence[str], shape: str, columns: int = 3) -> DataFrame:
    """The rows of the pipe tables of documents, given as lines: key, order, id, cells, entry and problem.

    Lines between fences (three backticks), lines that don't begin with a pipe and rows of dashes are no rows; the first
    row of a document whose first cell is one of `header` (in any case) is its header. Of the rows with an id the first
    one is the entry. No row is dropped without a word: those of another number of columns, without an id or with one
    given before are told as problems and are no entries; one whose id hasn't the shape is an entry and a problem; a
    document without a header has a problem at line null.
    """
    text = F.trim(line)
    fence = text.startswith("```")
    w = Window.partitionBy(key).orderBy(order)
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(key, order, text.alias("_t"), fence.alias("_fence")).withColumn("_in", F.sum(F.col("_fence").cast("int")).over(to_here) % 2 == 1)
    rows = rows.withColumn("cells", F.when(~F.col("_fence") & ~F.col("_in") & F.col("_t").startswith("|"), row_cells(F.col("_t"))))
    dashes = F.forall("cells", lambda c: (c == "") | c.rlike("^:?-+:?$"))
    rows = rows.withColumn("cells", F.when(~dashes, F.col("cells")))
    like = F.coalesce(F.lower(F.get("cells", F.lit(0))).isin([h.lower() for h in header]), F.lit(False))
    rows = rows.withColumn("_like", like).withColumn("_head", F.col("_like") & (F.sum(F.col("_like").cast("int")).over(to_here) == 1))
    headless = rows.groupBy(key).agg(F.max("_head").alias("_any")).filter("NOT _any")
    arity, own = F.size("cells"), F.get("cells", F.lit(0))
    fits = (arity == columns) & (own != "")
    data = rows.filter("cells IS NOT NULL AND NOT _head").withColumn("id", F.when(fits, own))
    before = F.row_number().over(Window.partitionBy(key, "id").orderBy(order)) > 1
    data = data.withColumn("_again", F.col("id").isNotNull() & before)
    wrong = F.when(arity != columns, F.concat(F.lit(f"expected {columns} columns, got "), arity.cast("string"))).when(own == "", "empty id")
    problem = wrong.when(F.col("_again"), "duplicate id").when(~own.rlike(shape), "odd id")
    out = data.select(key, order, "id", "cells", (F.col("id").isNotNull() & ~F.col("_again")).alias("entry"), problem.alias("problem"))
    none = {c: F.lit(None).cast(out.schema[c].dataType) for c in (order, "id", "cells")}
    missing = headless.withColumns(none).select(key, order, "id", "cells", F.lit(False).alias("entry"), F.lit("no header").alias("problem"))
    return out.unionByName(missing)


def whole_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, digest and text of every file below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), F.decode("content", "utf-8").alias("text"))


def report_sink(df: DataFrame, path: str, by: Sequence[str], kind: str = "json", order: Sequence[str] = (), stamped: bool = False) -> None:
    """Write df as one folder for each value of `by`, every file in the order of `by` and `order`.

    stamped adds the day of writing (year-month-day) as a column; digests are taken before the sink, so it is in none.
    """
    out = df.withColumn("stamp", F.date_format(F.current_date(), "yyyy-MM-dd")) if stamped else df
    out.sortWithinPartitions(*by, *order).write.mode("overwrite").partitionBy(*by).format(kind).save(path)
