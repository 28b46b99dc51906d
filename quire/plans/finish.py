"""Finished results: bodies cleaned, their findings counted, graded, under their headers and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import columns as K
from quire.operators import cleaning, findings
from quire.plans import grading
from quire.sources import tables as S

FIELDS = ["source", "source_hash", "status", "score", "issues", "findings"]


def finished(bodies: DataFrame, sources: DataFrame) -> DataFrame:
    """(result_id, target, status, score, issues, findings, text) of bodies (result_id, body, pages) and sources (result_id, source).

    A result is the cleaned body under its header. A body that the chain can't take keeps its text and has the issue `cleaning`;
    a result without a source is named by its id. Null bodies have no result.
    """
    known = bodies.where("body is not null").select("result_id", "pages", K.url_hash(F.encode("body", "UTF-8")).alias("source_hash"))
    clean = cleaning.clean(bodies.where("body is not null")).select("result_id", F.col("clean").alias("body"), F.col("error").isNotNull().alias("failed"))
    whole = clean.join(known, "result_id")
    found = findings.findings(clean.select("result_id", "body")).groupBy("result_id").agg(F.count("*").alias("findings"))
    out = whole.join(grading.grade(whole.select("result_id", "body", "pages")), "result_id").join(found, "result_id", "left")
    out = out.join(sources.select("result_id", "source").where("source is not null").dropDuplicates(["result_id"]), "result_id", "left")
    source = F.coalesce("source", F.concat(F.lit("result-"), F.col("result_id").cast("string")))
    issues = F.concat(F.col("issues"), F.when(F.col("failed"), F.array(F.lit("cleaning"))).otherwise(F.array()))
    out = out.withColumn("source", source).withColumn("issues", F.array_join(issues, ",")).withColumn("findings", F.coalesce("findings", F.lit(0)))
    return S.with_header(out, FIELDS).select("result_id", S.target_name(F.col("source")).alias("target"), "status", "score", "issues", "findings", F.col("body").alias("text"))
