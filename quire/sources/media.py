"""Pictures of results: links, copies of one picture, furniture that comes back on many pages, links rewritten in the bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import columns as K
from quire.operators.kernels import rows


def link_path(path: Column) -> Column:
    """A path as it may stand in a link: blanks, brackets, per cent signs and backslashes encoded."""
    out = F.replace(path, F.lit("%"), F.lit("%25"))
    for sign, code in ((" ", "%20"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E"), ("\\", "/"), ("#", "%23"), ("?", "%3F")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def local_path(target: Column) -> Column:
    """The decoded path of a local link that stays in its folder; null for addresses and for paths that lead out."""
    plain = F.regexp_replace(F.regexp_replace(target, "[?#].*$", ""), "%(?![0-9A-Fa-f]{2})", "%25")
    path = F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))
    return F.when(target.rlike(r"^(?i:[a-z][a-z0-9+.-]*:|//|#)") | path.rlike(r"(^|/)\.\.(/|$)|^/"), None).otherwise(path)


def links(lines: DataFrame) -> DataFrame:
    """(result_id, line_no, target) of the pictures of plain lines."""
    return lines.where("not protected").select("result_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(K.IMAGE), 2)).alias("target"))


def copies(files: DataFrame) -> DataFrame:
    """(result_id, path, kept): copies of one picture (result_id, path, content) and the first path that holds it; only copies have a row."""
    w = Window.partitionBy("result_id", "digest").orderBy("path")
    out = files.select("result_id", "path", F.sha2("content", 256).alias("digest")).withColumn("kept", F.first("path").over(w))
    return out.where("path <> kept").select("result_id", "path", "kept")


def furniture(files: DataFrame, least: int = 3, small: int = 512) -> DataFrame:
    """(result_id, path) of pictures that are decoration: one content on `least` pages or more, or hardly any content."""
    out = files.select("result_id", "path", "page", F.length("content").alias("size"), F.sha2("content", 256).alias("digest"))
    many = out.groupBy("result_id", "digest").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= least)
    return out.join(many, ["result_id", "digest"], "left").where(F.col("pages").isNotNull() | (F.col("size") < small)).select("result_id", "path")


def rewritten(bodies: DataFrame, targets: DataFrame) -> DataFrame:
    """(result_id, body): links to old targets lead to the new ones, those without a new one go, their text stays; targets:
    result_id, old, new. A result's targets are as many as its pictures."""
    import re

    by = targets.groupBy("result_id").agg(F.map_from_entries(F.collect_list(F.struct("old", F.coalesce("new", F.lit("")).alias("new")))).alias("targets"))

    def run(result, body, targets):
        have = dict(targets or ())

        def one(m: re.Match) -> str:
            if m[2] not in have:
                return m.group()
            return f"![{m[1]}]({have[m[2]]})" if have[m[2]] else m[1] if any(c.isalnum() for c in m[1]) else ""

        yield result, re.sub(K.IMAGE, one, body) if have else body

    both = bodies.where("body is not null").select("result_id", "body").join(by, "result_id", "left")
    return rows(both.select("result_id", "body", "targets"), run, "result_id bigint, body string")
