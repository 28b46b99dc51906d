"""Problem 2: per-document text quality statistics.

Every line of a text is judged by its layout: vertical alignment of delimiters with the neighbouring lines (tables),
markers, leaders and indentation that comes back with a period (lists), line lengths whose breaks don't come from
wrapping and their autocorrelation, and by its share of readable words (junk). The kind of the text is the kind that holds
more than half of it; where the lines leave a doubt (DOUBT), the ratios of function words, symbols, digits and sentence ends
of the whole text are weighed in. Labels of the texts are compared with the kinds in a query of their own.

Empty texts and texts of lost-page markers alone have kind 'empty'. Null texts and null elements give no row.
Repeated deliveries of a record give one row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common as C

SCHEMA = (
    "field_name string, rec_id bigint, pos int, kind string, n_words int, mean_word_len double, symbol_ratio double, digit_ratio double, line_end_punct double, "
    "common_word_share double, delimiter_alignment double, indent_period double, length_autocorr double, early_break double, prose_share double"
)
BULLET = re.compile(r"\s*(?:[-*+•–—·▪◦‣●○]|\(?\d{1,4}[.)]|\(?[a-zA-Zа-я][.)]|\(?[ivxlcIVXLC]{1,5}[.)]|\[[ xX]\])\s+\S")
LEADER = re.compile(r"(?:\.{3,}|(?:\s\.){3,}|…+|·{3,}|_{3,})\s*\d+\s*$")
ENTRY = re.compile(r"[^\W\d_][^.!?;:]*,\s*\d+(?:[-–,\s]+\d+)*\s*$")
SENTENCE_END = re.compile(r"[.!?…][\"'»”)\]]*\s*$")
GAP = re.compile(r"\S(?:\t|\s{3,}|\s{2,}(?=[\d–-]))(?=\S)")
WORD = re.compile(r"[^\W\d_]+")
VOWEL = re.compile(r"[aeiouyäöüàâéèêëîïôùûœæаеёиоуыэюяAEIOUYÄÖÜÀÂÉÈÊËÎÏÔÙÛŒÆАЕЁИОУЫЭЮЯ]")
PAIR = re.compile(r"[bcdfghjklmnpqrstvwxzбвгджзйклмнпрстфхцчшщ]{5,}")
NUMBER = re.compile(r"[-–+±]?\d[\d.,  ]*%?$")
HEAD = re.compile(r"\s*#{1,6}\s+\S")
DIGIT = re.compile(r"\d")
NOTHING = (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
FENCE = re.compile(r"\s*(?:```|~~~)")
PROSE, LIST, TABLE, JUNK = 0, 1, 2, 3
#: Share of lines at a regular indent, or autocorrelation of line lengths, from which unmarked lines are a list, if as many break early.
EARLY = 0.4
PERIODIC = 0.5
REGULAR = 0.5
KINDS = ("prose", "list", "table", "junk")
#: Shares of prose among the lines of a text between which its ratios decide.
DOUBT = (0.25, 0.75)


def delimiters(line: str) -> tuple[str, int]:
    """The delimiter of a line of columns and how often it stands there."""
    if (n := line.count("|")) >= 2:
        return "|", n
    if n := line.count("\t"):
        return "\t", n
    if (n := line.count(";")) >= 2:
        return ";", n
    if "  " in line and (n := len(GAP.findall(line.strip()))):
        return " ", n
    if (n := line.count(",")) >= 3 and not SENTENCE_END.search(line) and ", " not in line:
        return ",", n
    return ("|", 1) if " | " in line else ("", 0)


#: Something of it stands in every line of junk; a line without it needs no closer look.
SUSPECT = re.compile(
    r"[^\w\s,.;:()'’?!%+–—\"„“”«»&²³°/-]|[^\w\s]{3}|_|[¤©¬¶€™¿¾½]|\S{21}|(?<!\S)[^\W\d_]\s[^\W\d_](?!\S)|(?<!\S)[^\w\s]{2}(?!\S)|(?<!\S)[^\w\s–—&+*•|/-](?!\S)|"
    r"(?<![^\W\d_])[bcdfghjklmnpqrstvwxzбвгджзйклмнпрстфхцчшщBCDFGHJKLMNPQRSTVWXZБВГДЖЗЙКЛМНПРСТФХЦЧШЩ]{3,}(?![^\W\d_])|[bcdfghjklmnpqrstvwxzбвгджзйклмнпрстфхцчшщ]{5}"
)


def junk_share(line: str) -> float:
    """Share of the characters of a line that stand in no readable word or number."""
    if not SUSPECT.search(line):
        return 0.0
    total = bad = 0
    loose = 0
    for token in line.split():
        total += len(token)
        words = WORD.findall(token)
        letters = sum(map(len, words))
        if not letters:
            if not any(c.isdigit() for c in token):
                bad += len(token) if len(token) > 1 or token not in "-–—&+=*•|/" else 0
            elif len(token) > 20:
                bad += len(token)
            continue
        if letters < 0.5 * len(token) and not any(c.isdigit() for c in token):
            bad += len(token)
            continue
        longest = max(words, key=len)
        if len(token) > 30 and not VOWEL.search(token[:6]) or len(token) > 24 and any(c.isdigit() for c in token):
            bad += len(token)
        elif len(longest) == 1 and len(token) == 1:
            loose += 1
            if longest.lower() not in "aiyоàвикосуяéô":
                bad += 1
        elif not VOWEL.search(longest):
            if len(longest) > 3 or longest.islower() and len(longest) > 2 and not any(c.isdigit() for c in token):
                bad += len(token)
            elif any(c in "¤©¬¶§²€™»¿¾½" for c in token):
                bad += len(token)
        elif PAIR.search(longest) and len(VOWEL.findall(longest)) * 5 < len(longest):
            bad += len(token)
        elif any(c in "¤©¬¶€™¿¾½" for c in token):
            bad += len(token)
    if total and loose * 3 > total:
        bad = max(bad, 0.9 * total)
    return bad / total if total else 0.0


def correlation(lengths: list[int]) -> float:
    """The largest autocorrelation of line lengths at a lag of 1 to 3."""
    n = len(lengths)
    if n < 6:
        return 0.0
    mean = sum(lengths) / n
    d = [x - mean for x in lengths]
    var = sum(x * x for x in d)
    if not var:
        return 1.0
    return max(sum(d[i] * d[i + k] for i in range(n - k)) / var for k in (1, 2, 3))


def periodicity(indents: list[int]) -> float:
    """Share of indented lines whose indent is a multiple of the smallest one."""
    some = [i for i in indents if i]
    if len(some) < 2:
        return 0.0
    step = min(some)
    return sum(i % step == 0 for i in some) / len(indents)


def runs(lines: list[str], kinds: list[int], ends: list[bool]) -> list[tuple[int, int]]:
    """[i, j) of the longest runs of lines without mark, heading or sentence end."""
    out, i, n = [], 0, len(lines)
    while i < n:
        j = i
        while j < n and kinds[j] == PROSE and not ends[j] and not HEAD.match(lines[j]):
            j += 1
        if j > i:
            out.append((i, j))
        i = max(j, i + 1)
    return out


def figures(lines: list[str]) -> bool:
    """Numbers are half or more of the words of most lines, and about as many in each."""
    n = len(lines)
    if sum(bool(DIGIT.search(x)) for x in lines) < 0.75 * n:
        return False
    rows = [x.split() for x in lines]
    numbers = [sum(bool(NUMBER.match(w)) and w[-1] not in ".," for w in r) for r in rows]
    return min(map(len, rows)) >= 3 and sum(2 * k >= len(r) and k >= 2 for k, r in zip(numbers, rows)) >= 0.75 * n and max(numbers) - min(numbers) <= 1


def regular(lines: list[str]) -> bool:
    """Lines broken early whose indents come back or whose lengths repeat; wrapping breaks next to none early."""
    n = len(lines)
    lengths = [len(x) for x in lines]
    own = max(lengths)
    early = sum(len(a) + 1 + len(b.split(None, 1)[0]) <= own for a, b in zip(lines, lines[1:]))
    starts = sum(x.lstrip()[:1].isupper() for x in lines)
    if early < EARLY * (n - 1) or 0.2 * n < starts < 0.8 * n:
        return False
    indents = [len(x) - len(x.lstrip()) for x in lines]
    return len(set(indents)) > 1 and periodicity(indents) >= PERIODIC or correlation(lengths) >= REGULAR


def line_kinds(lines: list[str], measures: bool = True) -> tuple[list[int], dict]:
    """Kinds of the non-blank lines, and the layout measures of the text if they are asked for."""
    n = len(lines)
    kinds = [PROSE] * n
    delim = [delimiters(x) for x in lines]
    width = max(map(len, lines), default=0)
    ends = [bool(SENTENCE_END.search(x)) for x in lines]
    early = [len(a) + 1 + len(b.split(None, 1)[0] if b.split() else "") <= width for a, b in zip(lines, lines[1:])]
    aligned = 0
    for i, line in enumerate(lines):
        d, k = delim[i]
        near = [delim[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < n]
        if d and any(x[0] == d and abs(x[1] - k) <= (1 if k > 2 else 0) for x in near):
            aligned += 1
            if d not in ";," or k >= 2:
                cells = [c.strip() for c in (re.split(r"\t|\s{2,}", line.strip()) if d in " \t" else line.strip().strip("|").split(d))]
                short = sum(len(c.split()) <= 7 for c in cells)
                if short >= 0.7 * len(cells) and junk_share(line.replace(d, " ")) < 0.5:
                    kinds[i] = TABLE
    # rows of figures without a delimiter
    for i, j in runs(lines, kinds, ends):
        if j - i >= 3 and figures(lines[i:j]):
            kinds[i:j] = [TABLE] * (j - i)
    listish = []
    for i, line in enumerate(lines):
        if kinds[i] == TABLE:
            continue
        words = line.split()
        figure = line[-1].isdigit()
        if figure and LEADER.search(line):
            kinds[i] = LIST
        elif junk_share(line) > 0.5:
            kinds[i] = JUNK
        elif BULLET.match(line):
            if not (ends[i] and len(words) > 5):
                kinds[i] = LIST
                listish.append(i)
        elif figure and len(words) <= 9 and ENTRY.search(line):
            kinds[i] = LIST
    # a marked item that goes on in the next line is a wrapped sentence when that ends like one
    for i in listish:
        if i + 1 < n and kinds[i + 1] == PROSE and not early[i] and not HEAD.match(lines[i + 1]):
            j = i + 1
            while j < n and kinds[j] == PROSE and not ends[j] and j - i < 8:
                j += 1
            if j < n and kinds[j] == PROSE and ends[j]:
                kinds[i] = PROSE
    # runs of short unmarked lines that no wrapping explains
    i = 0
    while i < n:
        j = i
        while j < n and kinds[j] == PROSE and not ends[j] and len(lines[j].split()) <= 9 and not HEAD.match(lines[j]):
            j += 1
        if j - i >= 4:
            own = max(len(x) for x in lines[i:j])
            run = [len(a) + 1 + len(b.split(None, 1)[0]) <= own for a, b in zip(lines[i : j - 1], lines[i + 1 : j])]
            starts = sum(lines[k].lstrip()[:1].isupper() for k in range(i, j))
            if run and sum(run) >= 0.75 * len(run) and (starts >= 0.8 * (j - i) or starts <= 0.2 * (j - i)):
                for k in range(i, j):
                    kinds[k] = LIST
        i = max(j, i + 1)
    # indents that come back, line lengths that repeat
    for i, j in runs(lines, kinds, ends):
        if j - i >= 4 and regular(lines[i:j]):
            kinds[i:j] = [LIST] * (j - i)
    if not measures:
        return kinds, {}
    layout = {
        "aligned": aligned / n if n else 0.0,
        "period": periodicity([len(x) - len(x.lstrip()) for x in lines]),
        "corr": correlation([len(x) for x in lines]),
        "early": sum(early) / len(early) if early else 0.0,
        "ends": sum(ends) / n if n else 0.0,
    }
    return kinds, layout


def leaning(known: float, symbol: float, digit: float, ends: float) -> float:
    """How far the ratios of a text speak for prose (above 0) or against it: next to none of its signs are symbols or digits in
    prose, lines end like sentences, and in many languages a third of the words are function words, whose absence says nothing;
    none of them shifts it by more than a tenth."""
    parts = (max(0.0, known - 0.15) / 0.3, (0.1 - symbol) / 0.3, (0.1 - digit) / 0.3, (ends - 0.3) / 2)
    return sum(max(-0.1, min(0.1, x * 0.2)) for x in parts)


def judged(text: str, common: frozenset[str], measures: bool = True) -> tuple:
    """(kind, measures...) of one text; without measures those stay at zero."""
    if "<!--" in text or "[page " in text:
        text = C.PAGE_MARK.sub("", text)
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").split("\n")]
    lines = [x for x in lines if x.strip()]
    size = len(text) - text.count(" ") - text.count("\n")
    if not lines:
        return ("empty", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    kinds, m = line_kinds(lines, measures)
    weight = [0.0] * 4
    fence = False
    for line, kind in zip(lines, kinds):
        if FENCE.match(line):
            fence = not fence
            continue
        if not fence:
            weight[kind] += len(line) - line.count(" ") - (line.count(".") if kind == LIST and LEADER.search(line) else 0)
    total = sum(weight) or 1.0
    share = weight[PROSE] / total
    kind = "prose" if share >= 0.5 else KINDS[max((LIST, TABLE, JUNK), key=weight.__getitem__)]
    doubt = DOUBT[0] < share < DOUBT[1]
    if not measures and not doubt:
        return (kind, *NOTHING, share)
    words = WORD.findall(text)
    letters = sum(map(len, words))
    digits = len(DIGIT.findall(text))
    symbol = (size - letters - digits) / size if size else 0.0
    digit = digits / size if size else 0.0
    known = sum(w.lower() in common for w in words) / len(words) if words else 0.0
    if doubt:
        kind = "prose" if share + leaning(known, symbol, digit, sum(bool(SENTENCE_END.search(x)) for x in lines) / len(lines)) >= 0.5 else KINDS[max((LIST, TABLE, JUNK), key=weight.__getitem__)]
    if not measures:
        return (kind, *NOTHING, share)
    return (
        kind,
        len(words),
        letters / len(words) if words else 0.0,
        symbol,
        digit,
        m["ends"],
        known,
        m["aligned"],
        m["period"],
        m["corr"],
        m["early"],
        share,
    )


def quality(records: DataFrame, common_words: DataFrame, kind_only: bool = False, all_kinds: bool = False) -> DataFrame:
    """One row per text of records (field_name, rec_id, text or texts): kind and statistics.

    common_words is a list of function words (word) of at most VOCABULARY_BOUND rows, which goes along with the tasks; a longer
    one is refused. kind_only gives the kinds without statistics, of lists, tables and junk if not all_kinds are asked for.
    """
    common = frozenset(r.word.lower() for r in common_words.select("word").where("word is not null").distinct().limit(C.VOCABULARY_BOUND + 1).collect())
    if len(common) > C.VOCABULARY_BOUND:
        raise ValueError(f"more than {C.VOCABULARY_BOUND} function words")

    def kernel(field, rec, value):
        for pos, text in enumerate(value if isinstance(value, list) else (value,)):
            if text is None:
                continue
            kind, *rest = judged(text, common, not kind_only)
            if not kind_only or all_kinds or kind in ("list", "table", "junk"):
                yield field, rec, pos, kind, *rest

    return C.once(C.arrow_rows(C.narrow(records), kernel, SCHEMA), "field_name", "rec_id", "pos")


def both(spark: SparkSession, sf_dir: str, found_only: bool) -> DataFrame:
    common = C.table(spark, sf_dir, "common_words")
    return quality(C.bodies(spark, sf_dir), common, found_only).unionByName(quality(C.check_texts(spark, sf_dir), common, found_only))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, pos, kind, label, agrees): the label of each check text beside its kind; `bad` should stand for junk alone.

    agrees is null where there is no label. Texts beyond the list of labels have none.
    """
    kinds = quality(C.check_texts(spark, sf_dir), C.table(spark, sf_dir, "common_words"), True, True).select("rec_id", "pos", "kind")
    stated = C.table(spark, sf_dir, "ocr_error_checks").where("check_id is not null and labels is not null").dropDuplicates(["check_id"])
    stated = stated.select(F.col("check_id").cast("long").alias("rec_id"), F.posexplode("labels").alias("pos", "label"))
    both = kinds.join(stated, ["rec_id", "pos"], "left")
    return both.withColumn("agrees", (F.col("label") == "bad") == (F.col("kind") == "junk"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir, False)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir, True).select("field_name", "rec_id", "pos", "kind")
