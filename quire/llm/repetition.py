"""Problem 1: repetition inside a single document.

A public vocabulary gives each record its fertility: characters per token, share of byte-fallback tokens and token entropy,
of single tokens and of phrases of them. Rejection bands per script decide. Characters per token or byte fallback out of
the band of the script mean junk or no writing of that script ("odd"), which is no case however often it repeats itself. A
later copy of a phrase takes two bits at least off the sum of the phrase entropy, and covers PHRASE words at most, so a
record with a share s of repeated words lacks s / 2 bits a word: what lacks less is rejected ("ordinary"), and no case is
lost. Records in the band "repeats" are verified by their exact share; where every record's share is asked for, all are.

Null or empty texts give no row. A record without any word has share 0. Repeated deliveries of a record give one row.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from math import log2

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common as C

VOCABULARY = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
SHARE = 0.5
PHRASE = 4
#: script: (characters a token, least and most; byte-fallback share, most). Outside of them a record isn't ordinary writing.
#: Latin and Cyrillic hold the 0.1 to 99.9 per cent of the readable records of bands_of with a margin; the other scripts are as
#: wide as a vocabulary without words of theirs demands, where a character may take a byte token for each of its bytes.
BANDS = {"latin": (1.6, 6.5, 0.05), "cyrillic": (1.3, 5.0, 0.05), "greek": (0.4, 5.0, 0.6), "arabic": (0.4, 5.0, 0.6), "hebrew": (0.4, 5.0, 0.6), "indic": (0.3, 5.0, 0.9), "cjk": (0.3, 3.0, 0.9), "other": (0.25, 8.0, 1.0)}
SCRIPTS = [("latin", "\u0000", "\u024f"), ("greek", "\u0370", "\u03ff"), ("cyrillic", "\u0400", "\u052f"), ("hebrew", "\u0590", "\u05ff"), ("arabic", "\u0600", "\u06ff"), ("indic", "\u0900", "\u0dff"), ("cjk", "\u3040", "\u9fff"), ("cjk", "\uac00", "\ud7a3")]
UNIT = re.compile(r"[^\W\d_]+|\d+(?:[.,  ]\d+)*")
SCHEMA = (
    "field_name string, rec_id bigint, n_words int, n_tokens int, script string, chars_per_token double, byte_fallback_share double, "
    "token_entropy double, phrase_deficit double, band string, repeated_share double"
)


def repeated_share(units: list[str], lines: list[int], phrase: int = PHRASE) -> float:
    """Share of the words (numbers aside) in later copies of phrases of `phrase` or more units, or of whole lines.

    A number reads as 0, so copies may differ in it; a phrase has two words at least, so figures of a table are none.
    """
    n = len(units)
    real = [u != "0" for u in units]
    total = sum(real)
    if not total:
        return 0.0
    covered = bytearray(n)
    seen: set[tuple] = set()
    two = [0]
    for r in real:
        two.append(two[-1] + r)
    mark = b"\1" * phrase
    for i in range(n - phrase + 1):
        if two[i + phrase] - two[i] >= 2:
            gram = tuple(units[i : i + phrase])
            if gram in seen:
                covered[i : i + phrase] = mark
            else:
                seen.add(gram)
    known: set[tuple] = set()
    for a, b in zip(lines, lines[1:]):
        if 0 < b - a < phrase and two[b] > two[a]:
            key = tuple(units[a:b])
            if key in known:
                covered[a:b] = b"\1" * (b - a)
            known.add(key)
    return sum(1 for c, r in zip(covered, real) if c and r) / total


def script_of(text: str) -> str:
    """The script of at least half of the letters."""
    have: Counter = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            have[next((name for name, low, high in SCRIPTS if low <= c <= high), "other")] += n
    name, n = max(have.items(), key=lambda x: x[1], default=("other", 0))
    return name if 2 * n >= sum(have.values()) and n else "other"


def phrase_deficit(units: list[str], lines: list[int], phrase: int = PHRASE) -> float:
    """Bits a word that the entropy of phrases, and of lines shorter than one, lacks to that of phrases that are all different."""
    words = len(units) - units.count("0")
    if not words:
        return 0.0
    some = Counter(zip(*(units[i:] for i in range(phrase))))
    short = Counter(tuple(units[a:b]) for a, b in zip(lines, lines[1:]) if 0 < b - a < phrase)
    return sum(c * log2(c) for counts in (some, short) for c in counts.values() if c > 1) / words


class Fertility:
    """Words to tokens of the public vocabulary, remembered by word."""

    def __init__(self, path: str = VOCABULARY):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = [self.model.is_byte(i) for i in range(self.model.get_piece_size())]
        self.known: dict[str, tuple[int, ...]] = {}
        self.nlog = [0.0] + [i * log2(i) for i in range(1, 20_000)]

    def ids(self, word: str) -> tuple[int, ...]:
        if (x := self.known.get(word)) is None:
            if len(self.known) > 300_000:
                self.known.clear()
            x = self.known[word] = tuple(self.model.encode(word, num_threads=1))
        return x

    def measure(self, units: list[str]) -> tuple[int, float, float, float]:
        """Tokens, characters a token, byte-fallback share, entropy in bits."""
        tokens: Counter = Counter()
        chars = 0
        for word, n in Counter(units).items():
            chars += len(word) * n
            for i in self.ids(word):
                tokens[i] += n
        total = sum(tokens.values())
        if not total:
            return 0, 0.0, 0.0, 0.0
        back = sum(n for i, n in tokens.items() if self.byte[i])
        nlog = self.nlog
        h = log2(total) - sum(nlog[n] if n < len(nlog) else n * log2(n) for n in tokens.values()) / total
        return total, chars / total, back / total, h


def measured(field: str, rec: int, value, fertility: Fertility, share: float, everything: bool):
    texts = value if isinstance(value, list) else [value]
    units: list[str] = []
    lines = [0]
    whole = "\n".join(t for t in texts if t)
    if "<!--" in whole or "[page " in whole:
        whole = C.PAGE_MARK.sub("", whole)
    for line in whole.casefold().split("\n"):
        if line:
            units += ["0" if u[0].isdigit() else u for u in UNIT.findall(line)]
            lines.append(len(units))
    if not units:
        return
    total, cpt, back, h = fertility.measure(units)
    script = script_of(whole)
    low, high, most = BANDS[script]
    lacking = phrase_deficit(units, lines)
    band = "odd" if not low <= cpt <= high or back > most else "repeats" if lacking >= share / 2 else "ordinary"
    # the bands are made for `share`; the exact share of a record doesn't ask for them
    part = repeated_share(units, lines) if everything or band == "repeats" else 0.0
    if everything or part >= share:
        yield field, rec, len(units), total, script, cpt, back, h, lacking, band, part


def repetition(records: DataFrame, everything: bool = True, share: float = SHARE, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per record (field_name, rec_id, text or texts): fertility, band and exact share of repeated content.

    everything=False keeps the records of at least `share` in the band "repeats". Texts of one record are taken together.
    """
    rows = C.arrow_rows(C.narrow(records), measured, SCHEMA, lambda: (Fertility(vocabulary), share, everything))
    return C.once(rows, "field_name", "rec_id")


def bands_of(measured: DataFrame, reach: float = 0.001) -> DataFrame:
    """(script, least, most, back): the bands that hold all but `reach` of the records of each script, of rows of repetition()."""
    return measured.where("n_words >= 20").groupBy("script").agg(
        F.percentile_approx("chars_per_token", reach).alias("least"), F.percentile_approx("chars_per_token", 1 - reach).alias("most"), F.percentile_approx("byte_fallback_share", 1 - reach).alias("back")
    )


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [repetition(C.bodies(spark, sf_dir)), repetition(C.check_texts(spark, sf_dir))]
    return rows[0].unionByName(rows[1])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [repetition(C.bodies(spark, sf_dir), False), repetition(C.check_texts(spark, sf_dir), False)]
    return rows[0].unionByName(rows[1]).where(F.col("repeated_share") >= SHARE).select("field_name", "rec_id")
