"""Lines of bodies with zones, blocks and pages: one exchange by body serves all windows over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import columns as K
from quire.operators.zones import zoned  # noqa: F401 the lines that all of these work on


def order():
    return Window.partitionBy("result_id").orderBy("line_no")


def so_far():
    return order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def explode_lines(bodies: DataFrame) -> DataFrame:
    """(result_id, line_no, line); a null body has no lines, an empty one has one."""
    return bodies.where("body is not null").select("result_id", F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line"))


def with_blocks(lines: DataFrame) -> DataFrame:
    """block_id: runs of plain lines that aren't blank; null between them."""
    plain = (F.trim("line") != "") & ~F.col("protected")
    out = lines.withColumn("plain", plain)
    first = F.col("plain") & ~F.coalesce(F.lag("plain").over(order()), F.lit(False))
    return out.withColumn("block_id", F.when(F.col("plain"), F.sum(first.cast("int")).over(so_far()))).drop("plain")


def islands(df: DataFrame, flag: str, keys: list[str], order: str, name: str = "run_id") -> DataFrame:
    """Rows where flag holds, with the number of their run of neighbours."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn(name, F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w))
    return out.where(flag)


def repeated_runs(lines: DataFrame, least: int = 3) -> DataFrame:
    """(result_id, line, first_line, copies): equal filled lines one below the other, table rows aside."""
    out = lines.where("not protected").withColumn("fresh", (F.col("line") != F.coalesce(F.lag("line").over(order()), F.lit("\n"))) | (F.lag("line_no").over(order()) != F.col("line_no") - 1))
    out = out.withColumn("run_id", F.sum(F.col("fresh").cast("int")).over(so_far()))
    out = out.where(F.trim("line") != "").where(~F.col("line").rlike(K.TABLE_ROW))
    runs = out.groupBy("result_id", "run_id").agg(F.min("line").alias("line"), F.min("line_no").alias("first_line"), F.count("*").alias("copies"))
    return runs.where(F.col("copies") >= least).drop("run_id")


def repeat_groups(lines: DataFrame, least: int = 3, rate: float = 1.0, longest: int = 80, connector: int = 3, gap: int = 3) -> DataFrame:
    """(result_id, line, copies, median_gap, least_copies) of short lines that come back close to each other, least_copies times
    or more: `least`, in long bodies `rate` for 1000 lines.

    Headings, table rows, lines of formulas or pictures alone and a single short word repeat by design.
    """
    size = lines.groupBy("result_id").agg(F.greatest(F.lit(float(least)), F.count("*") * F.lit(rate) / 1000).alias("least_copies"))
    core = F.trim("line")
    design = F.col("line").rlike(K.HEADING) | K.has_cells(core) | core.rlike(K.MEDIA) | (F.regexp_replace(core, K.ANY_FORMULA, "") == "") | (~core.rlike(r"\s") & (F.length(core) <= connector))
    short = lines.where(~F.col("protected") & core.rlike(r"[\p{L}\p{N}]") & (F.length(core) <= longest) & ~design & ~F.col("line").rlike(K.PAGE_MARK)).select("result_id", core.alias("line"), "line_no")
    w = Window.partitionBy("result_id", "line").orderBy("line_no")
    gaps = short.withColumn("gap", F.col("line_no") - F.lag("line_no").over(w))
    out = gaps.groupBy("result_id", "line").agg(F.count("*").alias("copies"), F.median("gap").alias("median_gap"))
    return out.where((F.col("copies") >= least) & (F.col("median_gap") <= gap)).join(size, "result_id").where("copies >= least_copies")


def repeated_blocks(lines: DataFrame, least: int = 3) -> DataFrame:
    """Runs of equal blocks one below the other: (result_id, first_block, copies)."""
    blocks = lines.where("block_id is not null").groupBy("result_id", "block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    w = Window.partitionBy("result_id").orderBy("block_id")
    out = blocks.withColumn("fresh", (F.col("text") != F.coalesce(F.lag("text").over(w), F.lit(""))).cast("int"))
    out = out.withColumn("run_id", F.sum("fresh").over(w))
    return out.groupBy("result_id", "run_id").agg(F.min("block_id").alias("first_block"), F.count("*").alias("copies")).where(F.col("copies") >= least).drop("run_id")


def flattened_runs(lines: DataFrame, longest: int = 25, least: int = 6) -> DataFrame:
    """Runs of short lines without structure: (result_id, first_line, run_lines)."""
    short = ~F.col("protected") & (F.trim("line") != "") & (F.length("line") <= longest) & ~F.col("line").rlike(K.LIST_ITEM) & ~F.col("line").rlike(K.HEADING) & ~F.col("line").contains("|") & ~F.col("line").contains("$") & ~F.col("line").rlike(r"^[<!\[]")
    runs = islands(lines.withColumn("short", short), "short", ["result_id"], "line_no")
    return runs.groupBy("result_id", "run_id").agg(F.min("line_no").alias("first_line"), F.count("*").alias("run_lines")).where(F.col("run_lines") >= least).drop("run_id")


def hyphenations(lines: DataFrame) -> DataFrame:
    """Lines that end in a letter and a hyphen while the next one opens in lower case."""
    out = lines.withColumn("next", F.lead("line").over(order())).withColumn("next_protected", F.lead("protected").over(order()))
    return out.where(~F.col("protected") & ~F.col("display") & ~F.col("next_protected") & F.col("line").rlike(r"\p{L}-\s*$") & F.col("next").rlike(r"^\s*\p{Ll}")).select("result_id", "line_no", F.regexp_extract("line", r"(\p{L}+)-\s*$", 1).alias("head"), F.regexp_extract("next", r"^\s*(\p{L}+)", 1).alias("tail"))


def headings(lines: DataFrame) -> DataFrame:
    """(result_id, line_no, level, title, number, glued, previous): ATX headings outside of protected zones; a glued one has no
    blank behind its signs."""
    out = lines.where(~F.col("protected")).withColumn("level", K.heading_level(F.col("line"))).where("level is not null")
    out = out.select("result_id", "line_no", "level", K.heading_title(F.col("line")).alias("title"), F.col("line").rlike(K.GLUED).alias("glued"))
    return out.withColumn("number", F.regexp_extract("title", r"^(\d+(\.\d+)*)", 1)).withColumn("previous", F.lag("level").over(order()))


def off_mode(headings: DataFrame, least: int = 2) -> DataFrame:
    """Headings of one title whose level isn't the one most copies have (the shallower on a tie)."""
    by = headings.groupBy("result_id", F.lower("title").alias("key")).agg(F.mode("level", True).alias("usual"), F.count("*").alias("copies")).where(F.col("copies") >= least)
    return headings.withColumn("key", F.lower("title")).join(by, ["result_id", "key"]).where("level <> usual").select("result_id", "line_no", "level", "usual")


def section_path(headings: DataFrame) -> DataFrame:
    """The section above each heading: the nearest earlier one of a lower level."""
    w = Window.partitionBy("result_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("line_no")), ignorenulls=True).over(w)) for k in range(1, 6)]
    return headings.withColumn("parent", F.greatest(*above))
