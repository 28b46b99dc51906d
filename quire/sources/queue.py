"""The queue of a run: which sources are to be done, frozen in a table so that a run that was broken off goes on where it was.

A queue is (path, name, size, source_hash, kind). It is written once, before the first source is worked on; a rerun reads it and
leaves out what has a finished result of the same content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import columns as K

#: How files of a kind begin (fixed values): extension, first bytes in hex.
SIGNATURES = {"pdf": ["25504446"], "djvu": ["41542654464F524D"], "docx": ["504B0304"], "odt": ["504B0304"], "epub": ["504B0304"], "rtf": ["7B5C727466"], "doc": ["D0CF11E0A1B11AE1"]}
TEXTS = ("md", "markdown", "txt", "html", "htm")
#: Exit codes (fixed values), from the least to the most serious.
EXIT = {"ok": 0, "partial": 4, "failed": 1, "usage": 2, "interrupted": 130}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,8})$", 1))


def defect(name: Column, content: Column) -> Column:
    """Why a source can't be read: empty, of no known kind, or not beginning like its kind; null if nothing is wrong."""
    kind = extension(name)
    out = F.when(F.length(content) == 0, "empty").when(~kind.isin(*SIGNATURES, *TEXTS), "unknown kind")
    for ext, heads in SIGNATURES.items():
        out = out.when((kind == ext) & ~F.hex(F.substring(content, 1, 16)).rlike("^(" + "|".join(heads) + ")"), "wrong signature")
    return out.when(kind.isin(*TEXTS) & F.hex(F.substring(content, 1, 1024)).rlike("^(..)*00(?=(..)*$)") & (F.length(content) > 0), "binary content")


def found(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size, source_hash, kind, defect) of the files below a folder; earlier results and hidden files are
    left out, and so are files without content, which the reader doesn't list."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = raw.select("path", name.alias("name"), F.col("length").alias("size"), K.url_hash(F.col("content")).alias("source_hash"), extension(name).alias("kind"), defect(name, F.col("content")).alias("defect"))
    return out.where(~F.col("name").rlike(r"^\.|_cleaned\.md$"))


def build(sources: DataFrame, results: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Sources without a defect and without a finished result (source, source_hash, status) of the same content, of the kinds to keep."""
    done = results.where("status in ('ok', 'bad')").select(F.col("source").alias("name"), "source_hash").distinct()
    out = sources.where("defect is null").drop("defect").join(done, ["name", "source_hash"], "left_anti")
    return out.where(F.col("kind").isin(*keep)) if keep else out


def save(queue: DataFrame, path: str) -> None:
    """Freezes the queue; a queue that is there stays, as it belongs to a run that was broken off."""
    queue.write.mode("error").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stubs(queue: DataFrame) -> DataFrame:
    """Results in progress, one for each source that is begun: (source, source_hash, status, score)."""
    return queue.select(F.col("name").alias("source"), "source_hash", F.lit("in_progress").alias("status"), F.lit(None).cast("double").alias("score"))


def named(sources: DataFrame, name: str = "name") -> DataFrame:
    """target: names of results, unique without regard to case; where stems meet the extension stays, and reserved names are set apart."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,8}$", ""), r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    stem = F.when(stem == "", "_").when(F.upper(stem).rlike(r"^(CON|PRN|AUX|NUL|COM\d|LPT\d)$"), F.concat(stem, F.lit("_"))).otherwise(stem)
    ext = F.regexp_extract(name, r"\.([A-Za-z0-9]{1,8})$", 1)
    md = F.lower(ext).isin("md", "markdown")
    out = sources.withColumn("_stem", stem).withColumn("_key", F.concat(F.lower(stem), F.when(md, "_cleaned").otherwise("")))
    same = out.groupBy("_key").agg(F.count("*").alias("_same"))
    target = F.concat("_stem", F.when((F.col("_same") > 1) & (ext != ""), F.concat(F.lit("_"), ext)).otherwise(""), F.when(md, "_cleaned.md").otherwise(".md"))
    return out.join(same, "_key").withColumn("target", target).drop("_key", "_stem", "_same")


def exit_code(statuses: DataFrame, status: str = "status") -> DataFrame:
    """(exit_code): the most serious of a run's outcomes; bad results are partial success, unfinished ones failures."""
    code = F.max(F.when(F.col(status) == "interrupted", 130).when(F.col(status).isin("in_progress", "failed"), 100).when(F.col(status) == "bad", 50).otherwise(0))
    return statuses.agg(code.alias("c")).select(F.when(F.col("c") == 130, EXIT["interrupted"]).when(F.col("c") == 100, EXIT["failed"]).when(F.col("c") == 50, EXIT["partial"]).otherwise(EXIT["ok"]).alias("exit_code"))
