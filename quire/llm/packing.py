"""Problem 7: filling fixed-capacity containers with items.

Hierarchical multi-length packing: documents are routed to context-size tiers (the capacity, a half, a quarter ... of
it), the long tier opens its windows, their gaps are filled from the shorter tiers, tightest gap first, what is left of a
tier opens windows of its own, and windows are dealt to step groups of equal load. Only a text of more tokens than
the capacity is split, between words. Packing runs in blocks of BLOCK documents; a block wastes less than one window.

Null and empty texts have no tokens and give no row. Rows with an equal doc_id are items of their own.
"""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common as C

TOKENIZER = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_multi_50k.tiktoken"
#: The tokenizer's own pre-splitting pattern (fixed values).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 100_000
TIERS = 5
STEPS = 8
#: White space and the word after it. No pre-token reaches over the end of a word, so their token counts add up.
CHUNK = re.compile(r"\s*\S+|\s+")
SIZES = "doc_id bigint, piece int, start_char int, end_char int, n_tokens int"
PACKED = "doc_id bigint, piece int, start_char int, end_char int, n_tokens int, container_id bigint, tier int, window_tier int, step_group int"


class Sizes(dict):
    """Tokens of a chunk of text, remembered."""

    def __init__(self, path: str = TOKENIZER):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("quire", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> int:
        n = len(self.encoding.encode_ordinary(chunk))
        if len(chunk) < 40:
            if len(self) > 1_000_000:
                self.clear()
            self[chunk] = n
        return n


def measured(doc, text, sizes: Sizes, capacity: int):
    """The pieces of a document: one, unless it has more tokens than the capacity."""
    if doc is None or not text:
        return
    chunks = CHUNK.findall(text)
    counts = list(map(sizes.__getitem__, chunks))
    total = sum(counts)
    if total <= capacity:
        yield doc, 0, 0, len(text), total
        return
    piece = start = at = have = 0
    for chunk, n in zip(chunks, counts):
        part = [(chunk, n)] if n <= capacity else list(torn(chunk, sizes, capacity))
        for c, k in part:
            if have + k > capacity:
                yield doc, piece, start, at, have
                piece, start, have = piece + 1, at, 0
            at += len(c)
            have += k
    yield doc, piece, start, at, have


def torn(chunk: str, sizes: Sizes, capacity: int):
    """A word of more tokens than the capacity, halved until its parts fit."""
    n = sizes[chunk]
    if n <= capacity or len(chunk) < 2:
        yield chunk, n
    else:
        mid = len(chunk) // 2
        yield from torn(chunk[:mid], sizes, capacity)
        yield from torn(chunk[mid:], sizes, capacity)


def tier_of(size: int, capacity: int) -> int:
    """0 for items of more than half of the capacity, 1 for more than a quarter, and so on; the last tier holds the rest."""
    tier = 0
    while tier < TIERS - 1 and size * 2 ** (tier + 1) <= capacity:
        tier += 1
    return tier


class Gaps:
    """Open windows by the room left in them; the tightest that is wide enough is a matter of a few bit operations."""

    def __init__(self, capacity: int):
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r: a window with room r is there

    def put(self, window: int, room: int) -> None:
        if room > 0:
            self.windows[room].append(window)
            self.rooms |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        tight = self.rooms >> size
        if not tight:
            return None
        room = size + (tight & -tight).bit_length() - 1
        window = self.windows[room].pop()
        if not self.windows[room]:
            self.rooms &= ~(1 << room)
        return window, room


def pack(sizes: list[int], capacity: int, routed: bool = True) -> tuple[list[int], list[int], list[int]]:
    """Window of each item, fill of each window, tier of each window (that of the item that opened it).

    Items are routed to tiers; the tiers are packed from long to short, the largest item of a tier first: it fills the tightest
    gap that longer tiers left, else it opens a window. routed=False packs the items in the order they come.
    """
    tiers: list[list[int]] = [[] for _ in range(TIERS)]
    for i, size in enumerate(sizes):
        tiers[tier_of(size, capacity) if routed else 0].append(i)
    where, fill, of = [0] * len(sizes), [], []
    gaps = Gaps(capacity)
    for tier, items in enumerate(tiers):
        for i in sorted(items, key=lambda i: -sizes[i]) if routed else items:
            window, room = gaps.take(sizes[i]) or (len(fill), capacity)
            if window == len(fill):
                fill.append(0)
                of.append(tier)
            where[i] = window
            fill[window] += sizes[i]
            gaps.put(window, room - sizes[i])
    return where, fill, of


def step_groups(fill: list[int], of: list[int], steps: int) -> list[int]:
    """Windows dealt out there and back, tier by tier and from the fullest on, so groups carry equal load of every tier."""
    group = [0] * len(fill)
    for rank, w in enumerate(sorted(range(len(fill)), key=lambda w: (of[w], -fill[w]))):
        lap, k = divmod(rank, steps)
        group[w] = k if lap % 2 == 0 else steps - 1 - k
    return group


def packed(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """One row per piece of a document: its window, tier and step group. documents: doc_id, text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null and text <> ''")
    sizes = C.arrow_rows(docs, measured, SIZES, lambda: (Sizes(tokenizer), capacity))
    blocks = max(1, -(-documents.count() // block))

    def fill_block(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, fill, of = pack(df.n_tokens.tolist(), capacity)
        groups = step_groups(fill, of, STEPS)
        df = df.drop(columns="block")
        df["container_id"] = [w * blocks + int(key[0]) for w in where]
        df["tier"] = [tier_of(n, capacity) for n in df.n_tokens]
        df["window_tier"] = [of[w] for w in where]
        df["step_group"] = [groups[w] for w in where]
        return df

    return sizes.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks))).groupBy("block").applyInPandas(fill_block, PACKED)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.splitting import limits

    return packed(C.table(spark, sf_dir, "documents"), limits(spark, sf_dir)["container"][0])
