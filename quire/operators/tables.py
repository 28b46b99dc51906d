"""Pipe tables: rows, cells, shapes and column forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import columns as K
from quire.operators.lines import islands


def rows(lines: DataFrame) -> DataFrame:
    """(result_id, table_id, line_no, row_no, is_rule, cells) of pipe tables of at least two rows with a rule in the second."""
    row = ~F.col("protected") & F.col("line").rlike(K.TABLE_ROW)
    runs = islands(lines.withColumn("is_row", row), "is_row", ["result_id"], "line_no", "table_id")
    w = Window.partitionBy("result_id", "table_id").orderBy("line_no")
    inner = F.regexp_replace(F.regexp_replace("line", r"^\s*\|", ""), r"\|\s*$", "")
    out = runs.select("result_id", "table_id", "line_no", F.row_number().over(w).alias("row_no"), F.col("line").rlike(K.TABLE_RULE).alias("is_rule"), F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda c: F.trim(c)).alias("cells"))
    has_rule = F.max(F.col("is_rule") & (F.col("row_no") == 2)).over(Window.partitionBy("result_id", "table_id"))
    return out.withColumn("ruled", has_rule).where("ruled").drop("ruled")


def shapes(rows: DataFrame) -> DataFrame:
    """(result_id, table_id, width, body_rows, odd_rows): odd rows have another number of cells than the rule."""
    width = F.max(F.when(F.col("row_no") == 2, F.size("cells"))).over(Window.partitionBy("result_id", "table_id"))
    out = rows.withColumn("width", width)
    return out.groupBy("result_id", "table_id", "width").agg(F.count(F.when(F.col("row_no") > 2, 1)).alias("body_rows"), F.count(F.when(F.size("cells") != F.col("width"), 1)).alias("odd_rows"))


def cells(rows: DataFrame) -> DataFrame:
    return rows.where("not is_rule").select("result_id", "table_id", "row_no", F.posexplode("cells").alias("col_no", "cell"))


def column_forms(cells: DataFrame) -> DataFrame:
    """(result_id, table_id, col_no, forms, filled): the forms of the values below the header."""
    body = cells.where("row_no > 2").withColumn("form", K.value_form(F.col("cell")))
    return body.groupBy("result_id", "table_id", "col_no").agg(F.array_sort(F.collect_set(F.when(F.col("cell") != "", F.col("form")))).alias("forms"), F.count(F.when(F.col("cell") != "", 1)).alias("filled"))


def empty_columns(cells: DataFrame) -> DataFrame:
    out = cells.groupBy("result_id", "table_id", "col_no").agg(F.max(F.length("cell")).alias("longest"))
    return out.where("longest = 0").drop("longest")


def split_tables(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(result_id, line_no, previous_line): tables with the header of the table before, with only blanks and page marks between."""
    head = rows.where("row_no = 1").select("result_id", "table_id", "line_no", F.concat_ws("|", "cells").alias("head"))
    last = rows.groupBy("result_id", "table_id").agg(F.max("line_no").alias("last_line"))
    w = Window.partitionBy("result_id").orderBy("line_no")
    pairs = head.join(last, ["result_id", "table_id"]).withColumn("before", F.lag("head").over(w)).withColumn("before_last", F.lag("last_line").over(w)).where("head = before")
    filled = lines.where((F.trim("line") != "") & ~F.col("line").rlike(K.PAGE_MARK)).select("result_id", F.col("line_no").alias("at"))
    between = pairs.join(filled, "result_id").where("at > before_last and at < line_no").select("result_id", "line_no").distinct()
    return pairs.join(between, ["result_id", "line_no"], "left_anti").select("result_id", "line_no", F.col("before_last").alias("previous_line"))


def padded(cells: DataFrame, ceiling: int = 120) -> DataFrame:
    """(result_id, table_id, row_no, line): rows laid out in columns of equal width where the table isn't too wide."""
    width = F.max(F.length("cell")).over(Window.partitionBy("result_id", "table_id", "col_no"))
    out = cells.withColumn("width", width).groupBy("result_id", "table_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "cell", "width"))).alias("c"))
    total = F.aggregate("c", F.lit(1), lambda a, x: a + x["width"] + 3)
    wide = F.transform("c", lambda x: F.when(total <= ceiling, F.rpad(x["cell"], x["width"], " ")).otherwise(x["cell"]))
    return out.select("result_id", "table_id", "row_no", F.concat(F.lit("| "), F.array_join(wide, " | "), F.lit(" |")).alias("line"))
