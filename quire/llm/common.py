"""Shared plumbing of the text operators: Arrow kernels, clean keys, corpus vocabularies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_MARK = re.compile(r"^[ \t]*(?:<!--.*?-->|\[page \d+ not recognized\])[ \t]*$", re.M)
WORD = re.compile(r"[^\W\d_]+")
VOCABULARY_BOUND = 200_000  # words that a vocabulary may hold when it is sent to every executor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. On one machine one below the warehouse is set where there is none; on a cluster
    the folder has to be named, as every executor must reach it."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def record(df: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """(field_name, rec_id, text) of the rows that have a key and some text; other columns are left behind."""
    return df.select(F.lit(field).alias("field_name"), F.col(key).cast("long").alias("rec_id"), F.col(text).alias("text")).where("rec_id is not null and text is not null and text <> ''")


def narrow(records: DataFrame) -> DataFrame:
    """field_name, rec_id and the text or texts of records; other columns, whatever their names, stay behind."""
    return records.select("field_name", "rec_id", "texts" if "texts" in records.columns else "text")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(table(spark, sf_dir, "ocr_results"), "result_id", "body", "body")


def check_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "ocr_error_checks")
    return t.select(F.lit("texts").alias("field_name"), F.col("check_id").cast("long").alias("rec_id"), "texts").where("rec_id is not null and texts is not null")


def block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record(table(spark, sf_dir, "block_outputs"), "block_key", "html", "html")


def arrow_rows(df: DataFrame, kernel: Callable[..., Iterable[tuple]], schema: str, setup: Callable[[], tuple] | None = None) -> DataFrame:
    """kernel(*columns of one row, *setup()) gives the rows that come of it; Arrow carries both ways.

    Only the columns of df travel to Python; rows of one batch are turned at once.
    """
    names = df.columns
    types = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = setup() if setup else ()
        for batch in batches:
            rows: list[tuple] = []
            cols = [batch.column(n).to_pylist() for n in names]
            for values in zip(*cols):
                rows.extend(kernel(*values, *extra))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return df.mapInArrow(run, types)


def counted(df: DataFrame, words_of: Callable[[str], Iterable[str]], most: int = 500_000) -> DataFrame:
    """(word, n) over the texts of df's only column; each task adds up its own words before they are shuffled."""
    schema = "word string, n bigint"
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            keys = list(have)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([have[k] for k in part], pa.int64())], schema=out)
            have.clear()

        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    for text in value if isinstance(value, list) else (value,):
                        if text:
                            have.update(words_of(text))
            if len(have) > most:
                yield from flush()
        yield from flush()

    return df.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def once(df: DataFrame, *keys: str) -> DataFrame:
    """A repeated delivery of a record is one record: distinct over the (few) found rows."""
    return df.dropDuplicates(list(keys) if keys else df.columns)
