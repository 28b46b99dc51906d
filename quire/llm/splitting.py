"""Problem 6: splitting oversized items at natural boundaries.

Recursive bisection: a span that is too long is cut at the strongest boundary near its midpoint, and the halves are cut
again while they exceed the limit less the overlap; then each piece but the first is given the last `overlap` characters
before it. Characters are code points.

Items at or under the limit give one piece, null and empty ones none. Sections are put together from their distinct
blocks in the order of pages and blocks; a section of more than BIG characters is first laid into runs of blocks, so no
task holds an unbounded one.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common as C

BIG = 4_000_000
#: Keys of long sections that are sent to every executor; more are joined.
SENT = 500_000
LIMITS = 1000
#: Boundaries from the strongest to the weakest; a cut stands at the end of the match.
BOUNDARIES = {
    "text": [re.compile(p) for p in (r"\n(?=[ \t]*#{1,6} )", r"\n(?=<!--)|\n[ \t]*\n", r"\n", r"(?<=[.!?…])[\"»”)]?\s+", r"[;:,]\s+", r"\s+")],
    "html": [re.compile(p) for p in (r"(?=<h[1-6]\b)", r"</(?:p|li|ul|ol|table|pre|h[1-6]|div)>(?=<)", r"</t[rd]>|<br\s*/?>|\n", r"(?<=[.!?…])\s+", r"(?<=>)|\s+(?=[^<>]*(?:<|$))", r"\s+")],
}
PIECES = "rec_id bigint, section_id string, part int, piece int, start int, core string"


def cut_point(text: str, a: int, b: int, rules: list[re.Pattern]) -> int:
    mid, reach = (a + b) // 2, max(1, (b - a) // 4)
    low, high = max(a + 1, mid - reach), min(b - 1, mid + reach)
    for rule in rules:
        best = 0
        for m in rule.finditer(text, low - 1, high):
            at = m.end()
            if low <= at <= high and (not best or abs(at - mid) < abs(best - mid)):
                best = at
            if best and at > mid + abs(best - mid):
                break
        if best:
            return best
    while mid < high and unicodedata.combining(text[mid]):
        mid += 1
    return mid


def spans(text: str, limit: int, overlap: int, kind: str = "text") -> list[tuple[int, int]]:
    """[start, end) of the pieces, which together are the text; more than one only if the text exceeds limit."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    room = max(1, limit - max(0, overlap))
    rules, out, todo = BOUNDARIES[kind], [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            out.append((a, b))
        else:
            m = cut_point(text, a, b, rules)
            todo += [(m, b), (a, m)]
    return out


def limits(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int]]:
    """The limits by name, of a table of one row a kind of item."""
    rows = C.table(spark, sf_dir, "size_limits").where("max_size is not null").limit(LIMITS + 1).collect()
    if len(rows) > LIMITS:
        raise ValueError(f"more than {LIMITS} size limits")
    return {r.limit_name: (r.max_size, r.overlap_size or 0) for r in rows}


def split_items(items: DataFrame, limit: int, overlap: int, kind: str) -> DataFrame:
    """Pieces without overlap of items (rec_id, section_id, part, whole_size, text); part orders the runs of one item.

    A run of an item that exceeds the limit as a whole is cut even if it is short enough itself.
    """

    def kernel(rec, section, part, whole, text):
        if text:
            room = limit if whole <= limit else max(1, limit - overlap)
            for i, (a, b) in enumerate(spans(text, room, 0 if whole > limit else overlap, kind)):
                yield rec, section, part, i, a, text[a:b]

    return C.arrow_rows(items.select("rec_id", "section_id", "part", "whole_size", "text"), kernel, PIECES)


def with_overlap(pieces: DataFrame, overlap: int) -> DataFrame:
    """Numbers the pieces of an item and puts the last characters before each piece in front of it."""
    w = Window.partitionBy("rec_id", "section_id").orderBy("part", "piece")
    before = F.coalesce(F.lag("core").over(w), F.lit(""))
    tail = F.expr(f"case when {overlap} > 0 then right(before, {overlap}) else '' end")
    out = pieces.withColumn("before", before).withColumn("number", F.row_number().over(w) - 1)
    return out.select("rec_id", "section_id", F.col("number").cast("int").alias("piece"), F.length(tail).alias("overlap"), F.concat(tail, "core").alias("text"))


def body_items(spark: SparkSession, sf_dir: str, limit: int | None) -> DataFrame:
    b = C.bodies(spark, sf_dir).select("rec_id", F.lit("").alias("section_id"), F.lit(0).alias("part"), F.length("text").cast("long").alias("whole_size"), "text")
    return C.once(b.where(F.col("whole_size") > limit) if limit is not None else b, "rec_id")


def sections(spark: SparkSession, sf_dir: str, limit: int | None) -> DataFrame:
    """Sections of blocks with their text; those over the limit only, if one is given."""
    t = C.table(spark, sf_dir, "block_outputs")
    deepest = F.expr("element_at(section_hierarchy, array_max(map_keys(section_hierarchy)))")
    blocks = t.select("block_key", F.col("result_id").cast("long").alias("rec_id"), F.when(F.size("section_hierarchy") > 0, deepest).alias("section_id"), "page_id", "block_id", F.coalesce("html", F.lit("")).alias("html"))
    blocks = blocks.where("section_id is not null and rec_id is not null and html <> ''")
    keys = ["rec_id", "section_id"]
    # lengths first: they find the sections whose text has to travel at all
    size = blocks.select("block_key", *keys, F.length("html").cast("long").alias("size")).dropDuplicates(["block_key"])
    whole = size.groupBy(*keys).agg(F.sum("size").alias("whole_size"))
    if limit is not None:
        whole = whole.where(F.col("whole_size") > limit)
    if limit is not None:
        # few sections are too long: where they are, the text of all others stays where it is
        whole = C.cut(whole)
        whole = F.broadcast(whole) if whole.count() <= SENT else whole
    own = blocks.join(whole, keys).dropDuplicates(["block_key"])
    w = Window.partitionBy(*keys).orderBy("page_id", "block_id", "block_key").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("part", F.floor(F.coalesce(F.sum(F.length("html").cast("long")).over(w), F.lit(0)) / BIG).cast("int"))
    rows = own.groupBy(*keys, "part").agg(F.max("whole_size").alias("whole_size"), F.array_sort(F.collect_list(F.struct("page_id", "block_id", "block_key", "html"))).alias("blocks"))
    return rows.select(*keys, "part", "whole_size", F.array_join(F.transform("blocks", lambda x: x["html"]), "").alias("text"))


def pieces(spark: SparkSession, sf_dir: str, over_only: bool = False) -> DataFrame:
    """(item_kind, result_id, section_id, piece, n_overlap, text) of every body and section."""
    by = limits(spark, sf_dir)
    out = []
    for kind, name, items, markup in (("body", "body", body_items, "text"), ("section", "section", sections, "html")):
        if name in by:
            limit, overlap = by[name]
            cut = with_overlap(split_items(items(spark, sf_dir, limit if over_only else None), limit, overlap, markup), overlap)
            out.append(cut.select(F.lit(kind).alias("item_kind"), F.col("rec_id").alias("result_id"), "section_id", "piece", F.col("overlap").alias("n_overlap"), "text"))
    if not out:
        return spark.createDataFrame([], "item_kind string, result_id bigint, section_id string, piece int, n_overlap int, text string")
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that came out in more than one piece."""
    return pieces(spark, sf_dir, True).where("piece = 1").select("item_kind", "result_id", "section_id")


FOUND_SQL = """
select 'body' as item_kind, result_id, '' as section_id from ocr_results
where length(body) > (select max_size from size_limits where limit_name = 'body') group by result_id
union all
select 'section', result_id, section_id from (
  select distinct block_key, result_id, coalesce(length(html), 0) as size, section_hierarchy[list_max(map_keys(section_hierarchy))] as section_id
  from block_outputs where cardinality(section_hierarchy) > 0
) group by result_id, section_id having sum(size) > (select max_size from size_limits where limit_name = 'section')
"""
