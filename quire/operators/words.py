"""Words as witnesses: counts, neighbours by one letter, compounds, attested joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"\p{L}+"


def prose(lines: DataFrame) -> DataFrame:
    """Lines of running text: no protected zones, formulas and page marks; code, targets and addresses blanked."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"`[^`]*`", " "), r"\]\([^()\s]*\)", "] "), r"(https?://|www\.)\S+|\S+@\S+", " ")
    return lines.where("not protected and not display and not startswith(line, '<!--')").withColumn("prose", text)


def word_counts(lines: DataFrame) -> DataFrame:
    """(result_id, word, n) in lower case."""
    words = prose(lines).select("result_id", F.explode(F.regexp_extract_all(F.lower("prose"), F.lit(f"({WORD})"), 1)).alias("word"))
    return words.groupBy("result_id", "word").agg(F.count("*").alias("n"))


def near_words(counts: DataFrame, shortest: int = 6, witness: int = 20) -> DataFrame:
    """(result_id, word, neighbour): words seen once that are one letter off exactly one word seen often.

    Both sides meet on keys with one letter left out of its place, so only words that agree elsewhere are paired.
    """
    keys = F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.lit("*"), F.substring("word", i + 1, F.length("word")))))
    long = counts.where(F.length("word") >= shortest)
    rare = long.where("n = 1").select("result_id", "word", keys.alias("key"))
    often = long.where(F.col("n") >= witness).select("result_id", F.col("word").alias("neighbour"), keys.alias("key"))
    pairs = rare.join(often, ["result_id", "key"]).groupBy("result_id", "word").agg(F.countDistinct("neighbour").alias("kinds"), F.min("neighbour").alias("neighbour"))
    return pairs.where("kinds = 1").drop("kinds")


def compounds(lines: DataFrame, ratio: int = 3) -> DataFrame:
    """(result_id, joined, broken_n, joined_n, decision) for words written with and without a hyphen."""
    text = prose(lines)
    hyphen = text.select("result_id", F.explode(F.regexp_extract_all(F.lower("prose"), F.lit(r"(\p{L}+-\p{L}+)"), 1)).alias("form")).groupBy("result_id", "form").agg(F.count("*").alias("broken_n"))
    hyphen = hyphen.withColumn("joined", F.regexp_replace("form", "-", ""))
    one = hyphen.groupBy("result_id", "joined").agg(F.count("*").alias("forms"), F.min("form").alias("form"), F.sum("broken_n").alias("broken_n")).where("forms = 1")
    whole = word_counts(lines).select("result_id", F.col("word").alias("joined"), F.col("n").alias("joined_n"))
    both = one.join(whole, ["result_id", "joined"])
    decision = F.when(F.col("joined_n") >= ratio * F.col("broken_n"), "join").when(F.col("broken_n") >= ratio * F.col("joined_n"), "break").otherwise("leave")
    return both.select("result_id", "joined", "form", "broken_n", "joined_n", decision.alias("decision"))


def attested_joins(hyphenations: DataFrame, counts: DataFrame, least: int = 2) -> DataFrame:
    """Broken words whose joined form the same body has `least` times elsewhere."""
    want = hyphenations.withColumn("word", F.lower(F.concat("head", "tail")))
    return want.join(counts.where(F.col("n") >= least).select("result_id", "word"), ["result_id", "word"], "left_semi")


def coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """(result_id, share): share of the words of left that right has as well."""
    hit = left.join(right.select("result_id", "word", F.lit(1).alias("hit")), ["result_id", "word"], "left")
    return hit.groupBy("result_id").agg((F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
