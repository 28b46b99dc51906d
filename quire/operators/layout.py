"""Layout blocks: reading order, headers hidden, captions, lists, tables over page cuts, joined paragraphs, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box(polygon: str = "polygon") -> list[Column]:
    """Left, top, right and bottom of a polygon of points."""
    xs = F.transform(polygon, lambda p: F.element_at(p, 1))
    ys = F.transform(polygon, lambda p: F.element_at(p, 2))
    return [F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")]


def visible_text(html: Column) -> Column:
    """Text of a block without tags; the five basic entities are read."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.regexp_replace(text, entity, char)
    return F.trim(text)


def reading_order(blocks: DataFrame, tolerance: float = 1.25) -> DataFrame:
    """place: order on the page; headers first and footnotes last, then by height rounded to steps of the tolerance, then from left."""
    out = blocks.select("*", *box())
    kind = F.when(F.col("block_type") == "PageHeader", 0).when(F.col("block_type") == "Footnote", 2).when(F.col("block_type") == "PageFooter", 3).otherwise(1)
    w = Window.partitionBy("result_id", "page_id").orderBy(kind, F.round(F.col("y0") / tolerance), "x0", "block_id")
    return out.withColumn("place", F.row_number().over(w))


def common_elements(blocks: DataFrame, copies: int = 4, streak: int = 3, share: float = 0.2, near: float = 0.02) -> DataFrame:
    """(result_id, block_key) of first and last blocks of pages whose text, figures aside, comes back on `copies` pages or more,
    `streak` of them in a row or a `share` of all, and stands at one height, give or take `near` of the page, twice at least."""
    text = F.trim(F.regexp_replace(F.lower(visible_text(F.col("html"))), r"[\d\s]+", " "))
    page = Window.partitionBy("result_id", "page_id")
    out = blocks.select("result_id", "block_key", "page_id", "block_id", "html", *box())
    out = out.withColumn("height", F.max("y1").over(page)).withColumn("edge", (F.col("block_id") == F.min("block_id").over(page)) | (F.col("block_id") == F.max("block_id").over(page)))
    pages = blocks.groupBy("result_id").agg(F.countDistinct("page_id").alias("pages"))
    out = out.where("edge and html is not null and html <> ''").withColumn("text", text).where("text <> ''").drop("html")
    same = Window.partitionBy("result_id", "text")
    by_height, by_page = same.orderBy("y0", "block_key"), same.orderBy("page_id")
    out = out.withColumn("beside", F.coalesce(F.col("y0") - F.lag("y0").over(by_height) <= near * F.col("height"), F.lit(False)).cast("int"))
    out = out.withColumn("island", F.col("page_id") - F.dense_rank().over(by_page))
    runs = out.groupBy("result_id", "text", "island").agg(F.countDistinct("page_id").alias("n"), F.max("beside").alias("beside"))
    runs = runs.groupBy("result_id", "text").agg(F.max("n").alias("streak"), F.sum("n").alias("on_pages"), F.max("beside").alias("beside"))
    hidden = runs.join(pages, "result_id").where((F.col("on_pages") >= copies) & (F.col("beside") == 1) & ((F.col("streak") >= streak) | (F.col("on_pages") >= share * F.col("pages"))))
    return out.join(hidden.select("result_id", "text"), ["result_id", "text"]).select("result_id", "block_key")


def image_furniture(blocks: DataFrame, band: float = 0.15, step: float = 0.015, least: int = 3) -> DataFrame:
    """(result_id, block_key) of pictures at one place in the upper or lower band of their page on `least` pages; places are
    shares of the page, and meet in steps, neighbours included."""
    page = Window.partitionBy("result_id", "page_id")
    pics = blocks.select("result_id", "block_key", "page_id", "block_type", *box()).withColumn("height", F.max("y1").over(page)).where("block_type = 'Picture'")
    pics = pics.where((F.col("y1") <= band * F.col("height")) | (F.col("y0") >= (1 - band) * F.col("height")))
    pics = pics.select("result_id", "block_key", "page_id", (F.col("x0") / F.col("height")).alias("x"), (F.col("y0") / F.col("height")).alias("y"))
    pics = pics.withColumn("sx", F.floor(F.col("x") / step)).withColumn("sy", F.floor(F.col("y") / step))
    near = pics.select("result_id", F.col("page_id").alias("other_page"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(F.array([F.struct((F.col("sx") + i).alias("sx"), (F.col("sy") + j).alias("sy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("s"))
    near = near.select("result_id", "other_page", "ox", "oy", "s.sx", "s.sy")
    pairs = pics.join(near, ["result_id", "sx", "sy"]).where((F.abs(F.col("x") - F.col("ox")) <= step) & (F.abs(F.col("y") - F.col("oy")) <= step))
    return pairs.groupBy("result_id", "block_key").agg(F.countDistinct("other_page").alias("pages")).where(F.col("pages") >= least)


def captions(blocks: DataFrame) -> DataFrame:
    """(result_id, caption_key, target_key): captions beside a picture or table of their page, the block before first."""
    w = Window.partitionBy("result_id", "page_id").orderBy("block_id")
    out = blocks.select("result_id", "page_id", "block_id", "block_key", "block_type")
    for name, f in (("before", F.lag), ("after", F.lead)):
        out = out.withColumn(f"{name}_type", f("block_type").over(w)).withColumn(f"{name}_key", f("block_key").over(w))
    target = F.when(F.col("before_type").isin("Picture", "Table", "Figure"), F.col("before_key")).when(F.col("after_type").isin("Picture", "Table", "Figure"), F.col("after_key"))
    return out.where("block_type = 'Caption'").select("result_id", F.col("block_key").alias("caption_key"), target.alias("target_key")).where("target_key is not null")


def list_groups(blocks: DataFrame) -> DataFrame:
    """(result_id, first_block, items): runs of list items in reading order, over pages too."""
    w = Window.partitionBy("result_id").orderBy("page_id", "block_id")
    out = blocks.where("block_type not in ('ListGroup', 'PageHeader', 'PageFooter')").withColumn("is_item", F.col("block_type") == "ListItem")
    out = out.withColumn("run", F.row_number().over(w) - F.sum(F.col("is_item").cast("int")).over(w)).where("is_item")
    return out.groupBy("result_id", "run").agg(F.min(F.struct("page_id", "block_id", "block_key"))["block_key"].alias("first_block"), F.count("*").alias("items")).drop("run")


def sections(blocks: DataFrame) -> DataFrame:
    """(result_id, section_id, blocks, chars): content of each section, by the heading at its greatest level."""
    deepest = F.expr("element_at(section_hierarchy, array_max(map_keys(section_hierarchy)))")
    out = blocks.where(F.size("section_hierarchy") > 0).withColumn("section_id", deepest)
    return out.groupBy("result_id", "section_id").agg(F.count("*").alias("blocks"), F.sum(F.coalesce(F.length("html"), F.lit(0)).cast("long")).alias("chars"))


def contents(blocks: DataFrame) -> DataFrame:
    """(result_id, block_key, level, title): the headings of a document in order."""
    level = F.regexp_extract("html", r"^<h([1-6])", 1)
    return blocks.where("block_type = 'SectionHeader' and html is not null").select("result_id", "block_key", "page_id", "block_id", F.when(level != "", level.cast("int")).alias("level"), visible_text(F.col("html")).alias("title"))


def joined_paragraphs(blocks: DataFrame) -> DataFrame:
    """(result_id, block_key, next_key): text blocks that a page cuts: no sentence end before it, lower case or a hyphen after it."""
    text = visible_text(F.col("html"))
    w = Window.partitionBy("result_id").orderBy("page_id", "block_id")
    flow = blocks.where("block_type in ('Text', 'TextInlineMath') and html is not null and html <> ''").withColumn("text", text).where("text <> ''")
    out = flow.select("result_id", "block_key", "page_id", "text", F.lead("block_key").over(w).alias("next_key"), F.lead("page_id").over(w).alias("next_page"), F.lead("text").over(w).alias("next_text"))
    open_end = ~F.col("text").rlike(r"[.!?:;…][\"'»”)]*$")
    return out.where((F.col("next_page") == F.col("page_id") + 1) & (F.col("text").rlike(r"\p{L}-$") | open_end) & F.col("next_text").rlike(r"^\p{Ll}")).select("result_id", "block_key", "next_key")


def table_grid(blocks: DataFrame) -> DataFrame:
    """(result_id, block_key, page_id, block_id, n_rows, n_cells, first_row) of the tables among the blocks."""
    first = F.regexp_extract("html", r"(?s)<tr>(.*?)</tr>", 1)
    return blocks.where("block_type = 'Table' and html is not null").select("result_id", "block_key", "page_id", "block_id", F.regexp_count("html", F.lit("<tr>")).alias("n_rows"), F.regexp_count("html", F.lit("<t[dh]>")).alias("n_cells"), first.alias("first_row"))


def merged_tables(blocks: DataFrame) -> DataFrame:
    """(result_id, block_key, next_key, repeats_header): the last table of a page and the first one of the next with as many
    columns, whose first row repeats the header or reads as data: half or more of its filled cells are figures."""
    grid = table_grid(blocks).withColumn("columns", F.col("n_cells") / F.greatest(F.col("n_rows"), F.lit(1)))
    w = Window.partitionBy("result_id").orderBy("page_id", "block_id")
    out = grid.select("*", *[F.lead(c).over(w).alias(f"next_{n}") for c, n in (("block_key", "key"), ("page_id", "page"), ("columns", "columns"), ("first_row", "first"))])
    cells = F.filter(F.transform(F.regexp_extract_all("next_first", F.lit(r"(?s)<t[dh]>(.*?)</t[dh]>"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))), lambda c: c != "")
    figures = F.filter(cells, lambda c: c.rlike(r"^[-–+±]?\d[\d.,\s]*%?$"))
    data = (F.size(cells) > 0) & (2 * F.size(figures) >= F.size(cells))
    again = F.col("next_first") == F.col("first_row")
    return out.where((F.col("next_page") == F.col("page_id") + 1) & (F.col("columns") == F.col("next_columns")) & (again | data)).select("result_id", "block_key", "next_key", again.alias("repeats_header"))


def quote_levels(blocks: DataFrame, step: float = 0.02) -> DataFrame:
    """(result_id, block_key, level): text blocks that follow each other on a page and stand in from both sides of the page's text,
    `step` of its width a level; those at the margin are left out."""
    page = Window.partitionBy("result_id", "page_id")
    out = blocks.where("block_type = 'Text'").select("result_id", "page_id", "block_key", *box())
    out = out.withColumn("left", F.min("x0").over(page)).withColumn("right", F.max("x1").over(page)).withColumn("width", F.col("right") - F.col("left"))
    inset = (F.col("x0") - F.col("left")) / F.greatest(F.col("width"), F.lit(1.0))
    level = F.floor(inset / step + 1e-9).cast("int")
    return out.where((level >= 1) & (F.col("x1") <= F.col("right") - step * F.col("width"))).select("result_id", "block_key", level.alias("level"))


def list_levels(blocks: DataFrame, step: float = 5.0) -> DataFrame:
    """(result_id, block_key, level): list items of a page, a level for each step of indentation that is in use there."""
    out = blocks.where("block_type = 'ListItem'").select("result_id", "page_id", "block_key", *box()).where("x0 is not null")
    w = Window.partitionBy("result_id", "page_id").orderBy(F.floor(F.col("x0") / step))
    return out.select("result_id", "block_key", F.dense_rank().over(w).alias("level"))


def footnotes(blocks: DataFrame) -> DataFrame:
    """(result_id, block_key, mark, text): footnotes with the number or sign they open with, null if there is none."""
    text = visible_text(F.col("html"))
    mark = F.regexp_extract(text, r"^(\d{1,3}|[*†‡]+)[.)]?\s+\S", 1)
    return blocks.where("block_type = 'Footnote' and html is not null").select("result_id", "block_key", F.when(mark != "", mark).alias("mark"), F.trim(F.regexp_replace(text, r"^(\d{1,3}|[*†‡]+)[.)]?\s+", "")).alias("text"))


def numbered_margins(blocks: DataFrame, share: float = 0.6, least: int = 3) -> DataFrame:
    """(result_id, block_key, lines, numbered): text blocks most of whose lines begin or end with a line number of their own."""
    lines = F.filter(F.transform(F.split("html", r"(?i)<br\s*/?>"), visible_text), lambda x: x != "")
    numbered = F.filter(lines, lambda x: x.rlike(r"^\d{1,4}\s+\S|\S\s+\d{1,4}$"))
    out = blocks.where("block_type = 'Text' and html is not null").select("result_id", "block_key", F.size(lines).cast("long").alias("lines"), F.size(numbered).cast("long").alias("numbered"))
    return out.where((F.col("lines") >= least) & (F.col("numbered") > share * F.col("lines")))


def clusters(heights: list[float], k: int = 4, merge: float = 0.2) -> list[int]:
    """Level of each height, 1 for the greatest: the best split of the sorted heights into at most k groups, in squared distance;
    groups whose means differ by less than `merge` of the greater one are one level."""
    order = sorted(set(heights), reverse=True)
    n = len(order)
    if not n:
        return []
    weight = [heights.count(h) for h in order] if n < 200 else [1] * n
    total = [0.0] * (n + 1)
    first, second = total[:], total[:]
    for i, (h, c) in enumerate(zip(order, weight)):
        total[i + 1], first[i + 1], second[i + 1] = total[i] + c, first[i] + c * h, second[i] + c * h * h

    def cost(i: int, j: int) -> float:
        return second[j] - second[i] - (first[j] - first[i]) ** 2 / (total[j] - total[i])

    best = [[float("inf")] * (n + 1) for _ in range(k + 1)]
    cut = [[0] * (n + 1) for _ in range(k + 1)]
    best[0][0] = 0.0
    for g in range(1, k + 1):
        for j in range(1, n + 1):
            for i in range(g - 1, j):
                c = best[g - 1][i] + cost(i, j)
                if c < best[g][j] - 1e-12:
                    best[g][j], cut[g][j] = c, i
    g = min(range(1, min(k, n) + 1), key=lambda g: (best[g][n] > 1e-9 and g < min(k, n), g))
    bounds, j = [], n
    while j:
        i = cut[g][j]
        bounds.append((i, j))
        j, g = i, g - 1
    level_of, level, last = {}, 0, 0.0
    for i, j in reversed(bounds):
        mean = (first[j] - first[i]) / (total[j] - total[i])
        if not level or last - mean >= merge * last:
            level, last = level + 1, mean
        level_of.update((h, level) for h in order[i:j])
    return [level_of[h] for h in heights]


def heading_heights(blocks: DataFrame) -> DataFrame:
    """(result_id, block_key, level): headings of a file by the clusters of their heights. A file's headings meet in one row."""
    from quire.operators.kernels import rows

    heads = blocks.where("block_type = 'SectionHeader'").select("result_id", "block_key", *box()).withColumn("height", F.col("y1") - F.col("y0")).where("height is not null")
    files = heads.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("block_key", "height"))).alias("heads"))

    def run(result, heads):
        for h, level in zip(heads, clusters([round(h["height"], 1) for h in heads])):
            yield result, h["block_key"], level

    return rows(files, run, "result_id bigint, block_key bigint, level int")


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(result_id, body): blocks in order as Markdown; headers and footers stay out, list groups give way to their items.

    Blocks meet in one row per document; a document is the unit of output here, so that row is as large as its result.
    """
    html = F.col("html")
    level = F.regexp_extract(html, r"^<h([1-6])", 1)
    text = visible_text(html)
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<tr>(.*?)</tr>"), 1), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<t[dh]>(.*?)</t[dh]>"), 1), visible_text), " | "), F.lit(" |")))
    rule = F.regexp_replace(F.regexp_replace(F.element_at(rows, 1), r"[^|]+", " --- "), r"^ --- ", "")
    table = F.when(F.size(rows) > 0, F.concat_ws("\n", F.element_at(rows, 1), rule, F.when(F.size(rows) > 1, F.array_join(F.slice(rows, 2, F.size(rows)), "\n")))).otherwise(text)
    out = (
        F.when(F.col("block_type") == "SectionHeader", F.concat(F.repeat(F.lit("#"), F.when(level != "", level.cast("int")).otherwise(1)), F.lit(" "), text))
        .when(F.col("block_type") == "ListItem", F.concat(F.lit("- "), text))
        .when(F.col("block_type") == "Code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(F.col("block_type") == "Equation", F.concat(F.lit("$$ "), text, F.lit(" $$")))
        .when(F.col("block_type") == "Table", table)
        .otherwise(text)
    )
    flow = blocks.where("html is not null and html <> '' and block_type not in ('PageHeader', 'PageFooter', 'ListGroup')").select("result_id", "page_id", "block_id", out.alias("md")).where("md <> ''")
    return flow.groupBy("result_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "block_id", "md"))), lambda x: x["md"]), "\n\n").alias("body"))
