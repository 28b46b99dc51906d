"""Edit lists: decoding, guards, placing of quotes, chunks of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDITS = "array<struct<page:int,line:int,old:string,new:string>>"


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)


def reason(old: str = "old_text", new: str = "new_text") -> Column:
    """Why an edit is refused; the first rule that fails speaks, null if none does."""
    o, n = F.col(old), F.col(new)
    links = lambda c: F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(([^)]*)\)"), 1)
    marks = lambda c: F.regexp_extract(c, r"^(#{1,6} |)", 1)
    pipes = lambda c: F.regexp_count(c, F.lit(r"\|"))
    dollars = lambda c: F.regexp_count(c, F.lit(r"\$"))
    rules = [
        ("no text", n.isNull() | o.isNull()),
        ("no change", o == n),
        ("digits changed", numbers(o) != numbers(n)),
        ("image changed", links(o) != links(n)),
        ("heading mark changed", marks(o) != marks(n)),
        ("row shape changed", pipes(o) != pipes(n)),
        ("formula signs changed", dollars(o) % 2 != dollars(n) % 2),
        ("literal escape", n.contains("\\n") & ~o.contains("\\n")),
        ("reply syntax", n.rlike(r'^\s*[{\[]"')),
        ("line break hyphen lost", o.rlike(r"\p{L}-$") & ~n.rlike(r"-$")),
    ]
    out = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        out = F.when(fails, F.lit(name)).otherwise(out)
    return out


def decoded(replies: DataFrame, text: str = "reply") -> DataFrame:
    """One row per edit of a reply in JSON; fences around it and commas at its ends are forgiven, what can't be read gives none."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), r"(?s)^\s*```\w*\s*|\s*```\s*$", ""), r",\s*([\]}])", "$1")
    return replies.withColumn("edit", F.explode(F.from_json(plain, EDITS))).select(*[c for c in replies.columns if c != text], "edit.page", "edit.line", F.col("edit.old").alias("old_text"), F.col("edit.new").alias("new_text"))


def placed(edits: DataFrame, lines: DataFrame, window: int = 40) -> DataFrame:
    """(reply_id, line_no): the line that holds the quoted text, at the address or as the only one within `window` lines.

    Edits and lines meet in steps of the window, the neighbouring steps included, so no body is joined with itself as a whole.
    """
    step = lambda c: F.floor(c / window)
    asked = edits.where("old_text is not null and old_text <> '' and line is not null").select("reply_id", "result_id", (F.col("line") - 1).alias("at"), "old_text")
    asked = asked.withColumn("step", F.explode(F.array(*[step(F.col("at")) + i for i in (-1, 0, 1)])))
    there = lines.select("result_id", "line_no", "line", step(F.col("line_no")).alias("step"))
    hits = asked.join(there, ["result_id", "step"]).where((F.abs(F.col("line_no") - F.col("at")) <= window) & F.col("line").contains(F.col("old_text")))
    best = hits.groupBy("reply_id").agg(F.count("*").alias("n"), F.max((F.col("line_no") == F.col("at")).cast("int")).alias("exact"), F.min("line_no").alias("only"), F.min("at").alias("at"))
    return best.where("exact = 1 or n = 1").select("reply_id", F.when(F.col("exact") == 1, F.col("at")).otherwise(F.col("only")).cast("int").alias("line_no"))


def page_tokens(lines: DataFrame) -> DataFrame:
    """(result_id, page, tokens): a token is three characters; lines above the first mark are page 0."""
    return lines.groupBy("result_id", F.coalesce("page", F.lit(0)).alias("page")).agg(F.ceil(F.sum(F.length("line") + 1) / 3).cast("long").alias("tokens"))


def chunks(pages: DataFrame, budget: int = 2000, most_pages: int = 8) -> DataFrame:
    """(result_id, page, chunk): pages in order, a new chunk where the budget or the number of pages would be passed.

    The pages of a result meet once in one row, are folded into chunks there, and come apart again.
    """
    listed = pages.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("page", "tokens"))).alias("pages"))
    kind = "array<struct<page:int,chunk:int,have:bigint,n:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.coalesce((last["have"] + x["tokens"] <= budget) & (last["n"] < most_pages), F.lit(False))
        chunk = F.when(fits, last["chunk"]).otherwise(F.coalesce(last["chunk"] + 1, F.lit(0)))
        have, n = F.when(fits, last["have"]).otherwise(F.lit(0)) + x["tokens"], F.when(fits, last["n"]).otherwise(F.lit(0)) + 1
        return F.concat(acc, F.array(F.struct(x["page"].cast("int").alias("page"), chunk.cast("int").alias("chunk"), have.cast("long").alias("have"), n.cast("int").alias("n"))))

    folded = listed.select("result_id", F.explode(F.aggregate("pages", F.array().cast(kind), step)).alias("p"))
    return folded.select("result_id", "p.page", "p.chunk")
