"""Sources and sinks: the driver's tables, folders of Markdown, result headers and finished results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import columns as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(result_id, body, pages, lang): a record delivered twice is one.

    Kernels over bodies take far longer than their bytes tell, so the exchange keeps all of spark.sql.shuffle.partitions.
    """
    rows = table(spark, sf_dir, "ocr_results").where("result_id is not null").select("result_id", "archive_id", "body", "pages", "lang")
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "result_id").dropDuplicates(["result_id"])


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, a delivery repeated is one. Exchanged by result, so windows over results and pages need no other exchange."""
    return table(spark, sf_dir, "block_outputs").repartition("result_id").dropDuplicates(["result_id", "block_key"])


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each header."""
    w = Window.partitionBy("result_id").orderBy(F.desc("ingested_at"))
    return table(spark, sf_dir, "result_headers").withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, source_hash, body) of the Markdown files of one folder level, in order of their names.

    The hash of a finished result is that of its content without its own header, so a result is found to be what it was made of.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.decode("content", "UTF-8")
    own = F.regexp_extract(text, HEADER, 1).rlike(OWN_HEADER)
    digest = F.when(own, K.url_hash(F.encode(F.regexp_replace(text, HEADER, ""), "UTF-8"))).otherwise(K.url_hash(F.col("content")))
    out = raw.select("path", name.alias("name"), digest.alias("source_hash"), text.alias("body"))
    return out.withColumn("body", F.regexp_replace("body", "\r\n?", "\n")).orderBy(F.lower("name"), "name")


HEADER = r"(?s)^---\n(.*?)\n---\n{0,2}"
#: What tells the header of a result from front matter that the source has itself.
OWN_HEADER = r"(?m)^source_hash: "


def split_header(df: DataFrame, body: str = "body") -> DataFrame:
    """Front matter of a finished result as a map, and the body without it."""
    head = F.regexp_extract(body, HEADER, 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^\w+: "))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\w+): ", 1).alias("k"), F.regexp_replace(x, r"^\w+: ", "").alias("v")))
    return df.withColumn("header", F.when(head != "", F.map_from_entries(F.array_distinct(entries)))).withColumn(body, F.regexp_replace(body, HEADER, ""))


def with_header(df: DataFrame, fields: list[str], body: str = "body") -> DataFrame:
    """The body under a header of the given columns."""
    lines = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("null"))) for f in fields]
    return df.withColumn(body, F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""), F.col(body)))


def target_name(source):
    """Name of a result: the stem, unsafe characters out, no dots or spaces at the end, _cleaned for Markdown sources."""
    stem = F.regexp_replace(source, r"\.[A-Za-z0-9]{1,5}$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r'[<>:"/\\|?*]', "_"), r"[. ]+$", "")
    return F.concat(stem, F.when(F.lower(source).endswith(".md"), "_cleaned.md").otherwise(".md"))


def write_results(df: DataFrame, path: str) -> None:
    """Finished results, one folder per status; a rerun replaces what it writes."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status").parquet(path)


def write_markdown(df: DataFrame, folder: str) -> None:
    """One file a row (target, text) in a folder that all executors reach; a file is there as a whole or not at all, so a task that
    is run again does no harm. Targets that lead out of the folder are refused."""
    import os

    def write(rows) -> None:
        for r in rows:
            path = os.path.normpath(os.path.join(folder, r["target"]))
            if os.path.dirname(path) != os.path.normpath(folder):
                raise ValueError(f"target outside of the folder: {r['target']}")
            part = f"{path}.{os.getpid()}.part"
            with open(part, "w", encoding="utf-8", newline="\n") as f:
                f.write(r["text"] or "")
                f.flush()
                os.fsync(f.fileno())
            os.replace(part, path)

    df.select("target", "text").foreachPartition(write)


def unfinished(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Sources that have no finished result of the same content."""
    done = results.where("status in ('ok', 'bad')").select("source", "source_hash").distinct()
    return sources.join(done, ["source", "source_hash"], "left_anti")
