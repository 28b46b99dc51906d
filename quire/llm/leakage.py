"""Problem 8: evaluation texts leaking into training text.

A distributed positional inverted index: every task takes the postings (term, document, positions) out of its documents, a
term being three words in a row, and stores them. Which terms are looked up is decided by their frequency in the corpus:
of each segment of each test item the rarest ones, and all others but those of more than FREQUENT of the documents. Their
lists are joined by term, adjusted by the place in the item and intersected by offset. Documents with enough hits near one
offset are matched word by word around their hits, tolerant of single characters, spacing and markup: at least half of the
words of the passage, in their order, in one or two stretches. A match is a phrase if the document has the passage word by
word, else a proximity match.

Only terms of test items are stored: a bit table of at most MOST_BITS goes along with the tasks, and what it lets through by
chance meets no item in the join. The opening instruction that items share, in whatever part of the table, is no part of a
passage. Of passages of fewer than LEAST words the whole phrase is asked for; those of one or two words are none, and null or
empty texts give no row. Copies of a document count by themselves; rows of one doc_id give one row per item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common as C

LEAST = 8
SHARE = 0.5
SEGMENT = 10
RARE = 6
FREQUENT = 0.001
GAP = 5
STEP = 16
#: Bits of the table of test terms: so many a term, at most 64 MB in all.
BITS, MOST_BITS = 64, 1 << 29
#: Candidate documents that are sent to every executor; more are joined.
SENT = 200_000
WORD = re.compile(r"\w+")
TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
BROKEN = re.compile(r"(?<=\w)[-¬­]\s*\n\s*(?=\w)")
UNSEEN = re.compile("[​-‏⁠-⁤﻿­̀-ͯ]")
POSTINGS = pa.schema([("doc_id", pa.int64()), ("terms", pa.list_(pa.int64())), ("positions", pa.list_(pa.int32()))])


def words_of(text: str) -> list[str]:
    if "<" in text:
        text = TAG.sub(" ", text)
    if "-\n" in text or "- \n" in text or "¬" in text:
        text = BROKEN.sub("", text)
    return WORD.findall(text.casefold())


class Hashes(dict):
    """64 bits of a word, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word) | 1
        return x


def terms_of(codes: np.ndarray) -> np.ndarray:
    """Terms of the words (unsigned codes) that begin at each of them but the last two."""
    x = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + (codes[1:-1] ^ (codes[1:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[2:] * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def passages(items: DataFrame) -> DataFrame:
    """(item_id, words) of each item (item_id, text) without an opening paragraph that other items share."""

    def run(item, text):
        head, _, rest = text.partition("\n\n")
        yield item, " ".join(words_of(head)) if rest.strip() else None, words_of(text), words_of(rest)

    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null and text <> ''").dropDuplicates(["item_id"])
    rows = C.cut(C.arrow_rows(items, run, "item_id bigint, head string, whole array<string>, rest array<string>"))
    shared = rows.where("head is not null").groupBy(F.xxhash64("head").alias("head_key")).agg(F.count("*").alias("n")).where("n > 1").select("head_key", F.lit(True).alias("shared"))
    rows = rows.withColumn("head_key", F.xxhash64("head")).join(shared, "head_key", "left")
    return rows.select("item_id", F.when(F.col("shared") & F.col("head").isNotNull(), F.col("rest")).otherwise(F.col("whole")).alias("words")).where(F.size("words") >= 3)


def item_terms(passages: DataFrame) -> DataFrame:
    """(item_id, n_words, place, term)."""

    def run(item, words):
        known = Hashes()
        codes = np.array([known[w] for w in words], dtype=np.uint64)
        for place, term in enumerate(terms_of(codes).view(np.int64).tolist()):
            yield item, len(words), place, term

    return C.arrow_rows(passages.select("item_id", "words"), run, "item_id bigint, n_words int, place int, term bigint")


class BitTable:
    """Set of terms with three probes into a table of bits; it may let others through, but holds none of its own back."""

    def __init__(self, bits: int, parts: list[tuple[int, bytes]]):
        self.bits = bits
        self.table = np.zeros(bits // 8, dtype=np.uint8)
        for k, part in parts:
            self.table[k * 4096 : (k + 1) * 4096] = np.frombuffer(bytes(part), dtype=np.uint8)[: bits // 8]

    def holds(self, terms: np.ndarray) -> np.ndarray:
        out = np.ones(len(terms), dtype=bool)
        for shift in (0, 16, 32):
            at = (terms >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def bit_table(terms: DataFrame) -> BitTable:
    """The bit table of (term), put together inside the JVM; its size is bounded whatever the number of terms."""
    n = terms.count()
    bits = 1 << 15
    while bits < min(MOST_BITS, BITS * n):
        bits *= 2
    at = F.explode(F.array(*[F.shiftrightunsigned("term", k).bitwiseAND(F.lit(bits - 1)) for k in (0, 16, 32)]))
    rows = terms.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    return BitTable(bits, [(r.part, r.bits) for r in rows.toLocalIterator()])


def postings(docs: DataFrame, table) -> DataFrame:
    """(doc_id, terms, positions): of each document (doc_id, text) the terms that the broadcast bit table holds, where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Hashes().__getitem__
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(ids), 500):
                some = [words_of(t) for t in texts[k : k + 500]]
                flat: list[int] = []
                starts = [0]
                for words in some:
                    flat.extend(map(get, words))
                    flat.extend((0, 0))
                    starts.append(len(flat))
                codes = np.array(flat, dtype=np.uint64)
                if len(codes) < 3:
                    continue
                there = codes != 0
                terms = terms_of(codes)
                at = np.nonzero(there[:-2] & there[1:-1] & there[2:])[0]
                at = at[table.value.holds(terms[at])]
                if not len(at):
                    continue
                doc = np.searchsorted(starts, at, side="right") - 1
                cuts = np.nonzero(np.diff(doc))[0] + 1
                first = np.concatenate(([0], cuts))
                ends = pa.array(np.concatenate((first, [len(at)])), pa.int32())
                own = doc[first]
                found = terms[at].view(np.int64)
                places = (at - np.array(starts)[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k + d] for d in own.tolist()], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(found)), pa.ListArray.from_arrays(ends, pa.array(places))], schema=POSTINGS)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, terms array<bigint>, positions array<int>")


def looked_up(terms: DataFrame, frequency: DataFrame, documents: int, rare: int = RARE, frequent: float = FREQUENT) -> DataFrame:
    """The terms (item_id, n_words, place, term) to look up by their document frequency (term, df): of each segment the `rare`
    rarest, and all that at most a share `frequent` of the documents has. Terms that no document has are left out."""
    known = terms.join(frequency, "term")
    w = Window.partitionBy("item_id", F.floor(F.col("place") / SEGMENT)).orderBy("df", "place")
    return known.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= rare) | (F.col("df") <= max(1.0, frequent * documents))).select("item_id", "n_words", "place", "term")


def candidates(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, item_id, low, high): documents whose postings lie at a steady offset to those of an item, and where."""
    lists = index.select("doc_id", F.explode(F.arrays_zip("terms", "positions")).alias("p")).select("doc_id", F.col("p.terms").alias("term"), F.col("p.positions").alias("position"))
    hits = lists.join(terms, "term").withColumn("offset", F.floor((F.col("position") - F.col("place")) / STEP))
    keys = ["doc_id", "item_id", "offset"]
    steps = hits.groupBy(*keys).agg(F.count("*").alias("n"), F.max("n_words").alias("n_words"), F.min("position").alias("low"), F.max("position").alias("high"))
    # one place of the text hardly ever stays on one side of a step, so neighbours count together
    near = steps.withColumn("offset", F.explode(F.array(F.col("offset"), F.col("offset") - 1)))
    near = near.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("n_words").alias("n_words"), F.min("low").alias("low"), F.max("high").alias("high"))
    # a short passage has few terms, of a long one half of the words hold a tenth at least; of that one place has a quarter
    least = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("n_words") / 2) - 2), F.floor(F.col("n_words") / 10))
    near = near.where(F.col("n") >= F.greatest(F.least(F.lit(2), least), least / 4))
    both = near.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n"), F.max("n_words").alias("n_words"), F.min("low").alias("low"), F.max("high").alias("high"))
    return both.where(F.col("n") >= least).select("doc_id", "item_id", "low", "high")


def similar(a: str, b: str) -> bool:
    """Equal but for one or two single characters of a longer word."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < 3:
        return False
    if len(a) == len(b):
        wrong = sum(x != y for x, y in zip(a, b))
        return wrong <= (1 if len(a) < 8 else 2)
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def between(p: list[str], w: list[str]) -> int:
    """Words of p that stand in w in order, single characters and spacing aside; both are short."""
    if not p or not w:
        return 0
    if "".join(p) == "".join(w):
        return len(p)
    best = [[0] * (len(w) + 1) for _ in range(len(p) + 1)]
    for i, x in enumerate(p):
        for j, y in enumerate(w):
            k = max(best[i][j + 1], best[i + 1][j])
            if similar(x, y):
                k = max(k, best[i][j] + 1)
            if j and w[j - 1] + y == x:
                k = max(k, best[i][j - 1] + 1)
            if i and p[i - 1] + x == y:
                k = max(k, best[i - 1][j] + 2)
            best[i + 1][j + 1] = k
    return best[-1][-1]


def held(p: list[str], doc: list[str]) -> float:
    """Share of the words of p that doc holds in order in its best one or two stretches."""
    blocks = [b for b in SequenceMatcher(None, doc, p, autojunk=False).get_matching_blocks() if b.size]
    stretches: list[list[int]] = []  # start and end in doc, start and end in p, words, longest block
    for j, i, n in blocks:
        if stretches:
            s = stretches[-1]
            gj, gi = j - s[1], i - s[3]
            if gj <= GAP + 2 and gi <= GAP + 2:
                s[4] += n + between(p[s[3] : i], doc[s[1] : j])
                s[1], s[3], s[5] = j + n, i + n, max(s[5], n)
                continue
        stretches.append([j, j + n, i, i + n, n, n])
    good = []
    for s in stretches:
        if s[5] < 3:
            continue
        k = max(0, s[2] - GAP)
        s[4] += between(p[k : s[2]], doc[max(0, s[0] - (s[2] - k)) : s[0]])
        k = min(len(p), s[3] + GAP)
        s[4] += between(p[s[3] : k], doc[s[1] : s[1] + (k - s[3])])
        good.append(s[4])
    good.sort(reverse=True)
    return min(1.0, sum(good[:2]) / len(p)) if good else 0.0


def matched(p: list[str], doc: list[str], low: int, high: int) -> tuple[float, str]:
    """Share of the passage that the document holds around the words low to high, and whether it has it as a phrase."""
    near = doc[max(0, low - len(p) - 4 * GAP) : high + len(p) + 4 * GAP]
    if f" {' '.join(p)} " in f" {' '.join(near)} ":
        return 1.0, "phrase"
    return (held(p, near) if len(p) >= LEAST else 0.0), "proximity"


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(item_id, doc_id, share, match) of the documents (doc_id, text) that hold an item's (item_id, text) passage."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null and text <> ''")
    words = C.cut(passages(items))
    terms = C.cut(item_terms(words))
    table = docs.sparkSession.sparkContext.broadcast(bit_table(terms.select("term").distinct()))
    index = C.cut(postings(docs, table))
    frequency = index.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    some = C.cut(candidates(index, looked_up(terms, frequency, index.count())))
    by = some.join(words, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "low", "high", "words")).alias("asked"))
    few = some.count() <= SENT
    if few:
        docs = docs.join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")

    def run(doc, text, asked):
        there = words_of(text)
        for a in asked:
            x, how = matched(a["words"], there, a["low"], a["high"])
            if x >= share:
                yield a["item_id"], doc, x, how

    rows = C.arrow_rows(docs.join(by, "doc_id").select("doc_id", "text", "asked"), run, "item_id bigint, doc_id bigint, share double, match string")
    best = rows.groupBy("item_id", "doc_id").agg(F.max(F.struct("share", "match")).alias("best"))
    return best.select("item_id", "doc_id", "best.share", "best.match")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "eval_items"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("item_id", "doc_id")
