"""Problem 5: noise in text from scanned pages.

Running headers are lines at page edges that come back, nearly equal, on other pages (left and right pages of a pair
together); page numbers are the numbers there that follow the pages. Words broken over a line or page end are joined when
the corpus vocabulary has the joined word; misread words are rare spellings of which another reading of their
characters is a frequent word of the corpus.

The vocabulary is counted inside the JVM; one kernel pass over the records then finds what they show by themselves and the
words to look up. Vocabulary and misread spellings stay distributed. Only the VOCABULARY_BOUND most frequent words go along
with the tasks, and only to skip words that need no look-up; all others are joined. A page edge is its first and last two
filled lines (of blocks: three short and three long ones), however long they are. Null and empty texts give no row, junk
lines no misread words. Repeated deliveries of a record give one row.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm.markup import BLOCK_TAG, FENCED, FORMULA, INLINE_CODE, TAG, blanked
from quire.llm.quality import HEAD, PROSE, SENTENCE_END, junk_share, line_kinds

CANDIDATES = "field_name string, rec_id bigint, kind string, word string, other string, n bigint"
#: Characters from which a line counts as long: it is compared with others word by word.
LONG_LINE = 130
PAGES = 3
EDGE = 3
#: Signs a letter is read as, and the letters they may stand for (fixed values).
SIGNS = {"0": "oоuö", "1": "liіт", "5": "s", "9": "g", "6": "bбgó", "8": "bвß", "3": "зэe", "4": "ч", "7": "т", "@": "aа", "!": "il", "|": "li", "+": "tт", "$": "s", "€": "e"}
#: Letters that are read for others: what stands there, what was printed (fixed values).
LETTERS = [("c", "e"), ("e", "c"), ("rn", "m"), ("m", "rn"), ("li", "h"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("l", "t"), ("t", "l"), ("и", "й"), ("й", "и"), ("п", "л"), ("п", "н"), ("л", "п"), ("н", "п"), ("и", "н"), ("н", "и"), ("ш", "щ"), ("щ", "ш"), ("ь", "ы"), ("с", "е"), ("е", "с"), ("б", "6")]
RATIO = 20
LEAST = 5
WORD = re.compile(r"[^\W\d_]+")
LONG = re.compile(r"[^\W\d_]{3,}")
MIXED = re.compile(r"(?<![\w@!+|$€/\\.:-])(?=[\d@!+|$€]*[^\W\d_])(?:[^\W\d_]|[0-9@!+|$€](?=[\w@!+|$€]*[^\W\d_])|(?<=[^\W\d_])[0-9@!+|$€])+(?![\w@|$€/\\])")
HYPHENS = {sign: re.compile(sign + r"[ \t]*\n") for sign in "-¬­‐"}
BROKEN = re.compile(r"(?<![^\W\d_])([^\W\d_]{2,})[ \t]?([-¬­‐])[ \t]*\n(?:[ \t]*\n)*[ \t]*([^\W\d_]{2,})")
#: The same with signs among the letters of its halves.
BROKEN_MIXED = re.compile(r"(?<![\w@!+|$€])([\w@!+|$€]{2,})[ \t]?[-¬­‐][ \t]*\n(?:[ \t]*\n)*[ \t]*([\w@!+|$€]{2,})")
MARK = re.compile(r"^[ \t]*<!-- ?source:page[^>]*-->[ \t]*$", re.M)
LOST = re.compile(r"^[ \t]*\[page \d+ not recognized\][ \t]*$", re.M)
SUSPENDED = frozenset("und oder bzw sowie bis wie and or to nor et ou ni и или либо da".split())
PAGE_WORD = r"page|seite|стр(?:аница|\.)?|с\.|s\.|p\.|pp\.|blatt|лист|folio|f\."
ALONE = [
    ("word", re.compile(rf"^(?:{PAGE_WORD})\s*(\d{{1,5}})(?:\s*(?:of|von|sur|de|из|/)\s*\d{{1,5}})?\.?$", re.I)),
    ("of", re.compile(r"^(\d{1,5})\s*/\s*\d{1,5}$")),
    ("of", re.compile(r"^(\d{1,5})\s+(?:of|von|sur|из)\s+\d{1,5}$", re.I)),
    ("dash", re.compile(r"^[—–-]\s*(\d{1,5})\s*[—–-]$")),
    ("square", re.compile(r"^\[\s*(\d{1,5})\s*\]$")),
    ("bare", re.compile(r"^(\d{1,4})\.?$")),
    ("roman", re.compile(r"^[—–-]?\s*([ivxlc]{1,7}|[IVXLC]{1,7})\s*[—–.-]?$")),
]
WITH = [
    ("left", re.compile(r"^(\d{1,5}|[ivxlc]{1,7})(?:\s{2,}|\s*[|•·]\s*|\t)(?P<rest>[^\W\d_].*)$")),
    ("right", re.compile(r"^(?P<rest>.*\S)(?:\s{2,}|\s*[|•·]\s*|\t)(\d{1,5}|[ivxlc]{1,7})$")),
    ("tail", re.compile(rf"^(?P<rest>.*\S)\s*[,|–—-]?\s+(?:{PAGE_WORD})\s*(\d{{1,5}})$", re.I)),
]
SURE = {"word", "of", "dash"}


DIGIT = re.compile(r"\d")
ROMAN_ALONE = re.compile(r"[—–-]?\s*(?:[ivxlc]{1,7}|[IVXLC]{1,7})\s*[—–.-]?")
ANY_ALONE = re.compile("|".join(f"(?:{rule.pattern})" for _, rule in ALONE), re.I)


def number(text: str) -> int:
    """An Arabic or a Roman number; 0 if it is no proper one."""
    if text.isdigit():
        return int(text)
    total, last = 0, 0
    for c in reversed(text.lower()):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c]
        total, last = (total - v, last) if v < last else (total + v, v)
    return total


def parsed(line: str) -> tuple[str, int | None, str]:
    """(key of the text beside a page number, number, form)."""
    line = line.strip()
    if not line:
        return "", None, ""
    if len(line) < 40 and (DIGIT.search(line) or ROMAN_ALONE.fullmatch(line)) and ANY_ALONE.match(line):
        for form, rule in ALONE:
            if m := rule.match(line):
                return "", number(m[1]), form
    first, last = line[0].isdigit() or line[0] in "ivxlc", line[-1].isdigit() or line[-1] in "ivxlc"
    for form, rule in WITH if first or last else ():
        if (first if form == "left" else last) and (m := rule.match(line)) and not re.search(r"\s{2,}|\t|\|", m["rest"].strip("| ")):
            return key_of(m["rest"]), number(m[1] if form == "left" else m[2]), form
    return key_of(line), None, ""


def key_of(line: str) -> str:
    return " ".join(WORD.findall(line.casefold()))


def like(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 0.2 * max(len(a), len(b)) or min(len(a), len(b)) < 5:
        return False
    s = SequenceMatcher(None, a, b, autojunk=False) if len(a) <= LONG_LINE else SequenceMatcher(None, a.split(), b.split(), autojunk=False)
    return s.quick_ratio() >= 0.85 and s.ratio() >= 0.85


def edges(lines: list[tuple[int, int, str, str]], paged: bool) -> tuple[set[int], set[int]]:
    """Of candidate lines (id, page, line, text after it) those of running headers and those of page numbers.

    paged: page is the page of the line; otherwise lines count in their order.
    """
    known: dict[str, tuple] = {"": ("", None, "")}
    for _, _, text, after in lines:
        for x in (text, after):
            if x not in known:
                known[x] = parsed(x)
    read = [(i, page, *known[text], "" if known[after][1] is not None else known[after][0]) for i, page, text, after in lines]
    headers: set[int] = set()
    numbers: set[int] = set()
    # groups of nearly equal keys
    groups: dict[str, list] = {}
    small = {i for i, _, text, _ in lines if (m := WORD.search(text)) and m.group()[0].islower()}
    for r in read:
        if len(r[2]) >= 4 and r[0] not in small:
            groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda k: -len(groups[k]))
    merged: list[list] = []
    heads: list[str] = []
    bucket: dict[str, list[int]] = defaultdict(list)
    for name in names:
        # nearly equal lines share their beginning or their end
        ends = ("<" + name[:5], ">" + name[-5:])
        for j in dict.fromkeys(j for e in ends for j in bucket[e]):
            if like(name, heads[j]):
                merged[j] += groups[name]
                break
        else:
            for e in ends:
                bucket[e].append(len(heads))
            heads.append(name)
            merged.append(list(groups[name]))
    pages_of = lambda g: {r[1] for r in g}

    def varied(g: list) -> bool:
        """What follows the copies differs from page to page; else whole pages are repeated."""
        after = [r[5] for r in g if r[5]]
        return not after or len(set(after)) >= 0.6 * len(after)

    text_of = {i: text.strip() for i, _, text, _ in lines}

    def titles(g: list) -> bool:
        """At most half of the copies read like sentences."""
        return 2 * sum(sentence(text_of[r[0]]) for r in g) <= len(g)

    rest = []
    for g in merged:
        if len(pages_of(g)) >= PAGES:
            if titles(g) and varied(g):
                headers.update(r[0] for r in g)
        elif len(g) <= 2:
            rest.append(g)
    # left and right pages: two lines in turn, three pages together
    rest = [(sorted(pages_of(g)), g) for g in rest]
    twice = [(own, g) for own, g in rest if len(own) == 2 and titles(g) and varied(g)]
    if paged:
        turns: dict[int, list] = defaultdict(list)
        between: dict[int, list] = defaultdict(list)
        for own, g in twice:
            if own[1] - own[0] == 2:
                turns[own[0]].append(g)
        for own, g in rest if turns else ():
            if len(own) == 1:
                between[own[0]].append(g)
        for low, those in turns.items():
            partners = turns.get(low + 1, []) + [g for g in between.get(low + 1, ()) if titles(g) and varied(g) and titled(text_of[g[0][0]])]
            for g in those + partners if partners else ():
                headers.update(r[0] for r in g)
    else:
        # two lines in turn cross each other: low < other low < high < other high
        twice.sort(key=lambda x: x[0])
        lows = [own[0] for own, _ in twice]
        for k, (own, g) in enumerate(twice):
            crossed = [o for o in range(k + 1, bisect_left(lows, own[1])) if lows[o] > own[0] and twice[o][0][1] > own[1]]
            for o in [k, *crossed] if crossed else ():
                headers.update(r[0] for r in twice[o][1])
    by_form: dict[str, list] = defaultdict(list)
    for r in read:
        if r[3] is not None and (not r[2] or r[0] in headers or r[4] == "tail"):
            by_form[r[4] if not r[2] else "header"].append(r)
    for form, g in by_form.items():
        g.sort(key=lambda r: (r[1], r[0]))
        shift: dict[int, list] = defaultdict(list)
        for k, r in enumerate(g):
            shift[r[3] - (r[1] if paged else k)].append(r)
        for s in shift.values():
            if len({r[1] for r in s}) >= (2 if paged or form not in ("bare", "roman") else 3):
                numbers.update(r[0] for r in s)
        if form in SURE:
            numbers.update(r[0] for r in g)
    return headers, numbers


def sentence(line: str) -> bool:
    words = WORD.findall(line)
    return bool(re.search(r"[.!?;:,]$", line)) and sum(w[0].isupper() for w in words) < 0.5 * len(words)


def titled(text: str) -> bool:
    letters = [c for c in text if c.isalpha()]
    return bool(re.search(r"\d{4}$", text)) or all(c.isupper() for c in letters) or len(text.split()) <= 10 and text[:1].isupper() and not re.search(r"[.,;:-]$", text)


NOT_EDGE = re.compile(r"^\s*(?:#{1,6}\s|[-*+•]\s+[^\d\s]|\d+[.)]\s|!\[|\||\$|\\|<|>|\(\d+\)$|```)")


def body_lines(text: str) -> tuple[list[str], list[tuple[int, int, str, str]], bool]:
    """Lines of a body, and its candidates for headers and page numbers."""
    lines = text.split("\n")
    marks = [i for i, x in enumerate(lines) if x.startswith("<!--") and MARK.match(x)]
    out = []
    filled = [i for i, x in enumerate(lines) if x.strip() and not x.startswith("<!--")]
    if marks:
        bounds = [-1, *marks, len(lines)]
        for page, (a, b) in enumerate(zip(bounds, bounds[1:])):
            own = [i for i in range(a + 1, b) if lines[i].strip()]
            for k, i in enumerate(own):
                if (k < 2 or k >= len(own) - 2) and not NOT_EDGE.match(lines[i]):
                    out.append((i, page, lines[i], lines[own[k + 1]] if k + 1 < len(own) else ""))
        return lines, out, True
    order = {i: k for k, i in enumerate(filled)}
    for i in filled:
        if not NOT_EDGE.match(lines[i]) and (i == 0 or not lines[i - 1].strip() or i + 1 >= len(lines) or not lines[i + 1].strip()):
            k = order[i]
            out.append((i, k, lines[i], lines[filled[k + 1]] if k + 1 < len(filled) else ""))
    return lines, out, False


def text_lines(texts: list) -> tuple[list[list[str]], list[tuple[int, int, str, str]]]:
    """Lines of the pages of a check, and the candidates; the id of a line is its place among the lines of all pages."""
    pages = [(t or "").split("\n") for t in texts]
    out = []
    start = 0
    for page, lines in enumerate(pages):
        own = [i for i, x in enumerate(lines) if x.strip()]
        for k, i in enumerate(own):
            if k < 2 or k >= len(own) - 2:
                out.append((start + i, page, lines[i], lines[own[k + 1]] if k + 1 < len(own) else ""))
        start += len(lines)
    return pages, out


RESIDUE = re.compile(r"&(?:amp;)*lt;/?[A-Za-z][^<>\n]{0,80}?&(?:amp;)*gt;|</?[A-Za-z][^<>\n]*>|\{\|[^\n]*|~?\\[A-Za-z]+(?:\{[\w:.-]*\})?|&[a-z]+;|\]\([^()\s]*\)|\{\{[^{}\n]*\}\}|[A-Z]:\\\S+|(?<!\S)\S*@\S*\.\S+", re.M)


def hyphens(text: str) -> list[int]:
    """Places of the hyphens at line ends."""
    return sorted(m.start() for sign, rule in HYPHENS.items() if sign in text for m in rule.finditer(text))


UNSEEN = re.compile("[\u200b-\u200f\u2060-\u2064\ufeff]")
UNSEEN_SIGNS = "\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"


def has_unseen(text: str) -> bool:
    """UNSEEN is in the text; one sign after the other is sought faster than all of them."""
    return not text.isascii() and any(c in text for c in UNSEEN_SIGNS)


def readable(text: str, words: set[str], signed: bool) -> str:
    """The lines of a text that aren't junk and hold one of the words or, if there are some, signs among letters."""
    lines = text.split("\n")
    if len(words) * len(lines) < 20_000:
        lines = [x for x in lines if any(w in x for w in words) or signed and SIGN.search(x)]
    return "\n".join(x for x in lines if junk_share(x) <= 0.5)


def without_marks(text: str) -> str:
    """Tags, commands, targets and paths of foreign markup are no words of the text; invisible signs don't end a word."""
    if has_unseen(text):
        text = UNSEEN.sub("", text)
    return RESIDUE.sub(" ", text) if "<" in text or "\\" in text or "{" in text or "](" in text or "&" in text or "@" in text else text


def kept(field: str, value) -> tuple[str, set[str]]:
    """The running text of a record without headers and page numbers, and which of the two it has."""
    has = set()
    if field == "body":
        text = value
        if "```" in text or "~~~" in text:
            text = blanked(FENCED, text)
        if "`" in text:
            text = blanked(INLINE_CODE, text)
        if "$" in text or "\\" in text:
            text = blanked(FORMULA, text)
        lines, cand, paged = body_lines(text)
        headers, numbers = edges(cand, paged) if cand else (set(), set())
        gone = headers | numbers
        text = "\n".join("" if i in gone or x.startswith("<!--") and MARK.match(x) else x for i, x in enumerate(lines))
        text = LOST.sub("", text)
    elif field == "texts":
        pages, cand = text_lines(value)
        headers, numbers = edges(cand, True)
        gone = headers | numbers
        lines = [x for page in pages for x in page]
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else "\n".join(lines)
    else:
        return htmllib.unescape(value) if "&" in value else value, has
    if headers:
        has.add("header")
    if numbers:
        has.add("pageno")
    return text, has


#: What a text is read as for the vocabulary, in one pass of the JVM: a word that no hyphen at a line end follows, or, with
#: nothing in the group, both halves of a broken word or a piece of foreign markup.
J_UNSEEN = "​‌‍‎‏⁠⁡⁢⁣⁤﻿"
J_WORD = (
    rf"([\p{{L}}\p{{Nl}}\p{{No}}{J_UNSEEN}]{{3,}}+(?![ \t]?[-¬­‐][ \t]*\n))|[\p{{L}}\p{{Nl}}\p{{No}}]++[ \t]?[-¬­‐][ \t]*\n(?:[ \t]*\n)*[ \t]*[\p{{L}}\p{{Nl}}\p{{No}}]{{2,}}+"
    r"|&(?:amp;)*lt;/?[A-Za-z][^<>\n]{0,80}?&(?:amp;)*gt;|</?[A-Za-z][^<>\n]*>|\{\|[^\n]*|\\[A-Za-z]+(?:\{[\p{L}\p{N}_:.-]*\})?|&[a-z]+;|\]\([^()\s]*\)|\{\{[^{}\n]*\}\}|[A-Z]:\\\S+"
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
OTHER_ENTITY = r"&(?!(?:amp|lt|gt|quot|nbsp|#39);)"


def without_tags(html: Column) -> Column:
    """The text of a block with its entities as they stand: code and formulas blanked, blocks on lines of their own."""
    aside = html.contains("<pre") | html.contains("<math") | html.contains("<code")
    text = F.when(aside, F.regexp_replace(html, r"(?is)<(pre|math|code)\b[^>]*>.*?</\1>", "\u0000")).otherwise(html)
    text = F.regexp_replace(text, r"(?i)<(?:/?(?:p|li|ul|ol|table|tr|div|h[1-6]|content-ref)\b[^<>]*|br\s*/?)>", "\n")
    return F.btrim(F.regexp_replace(text, r"</?[A-Za-z][^<>]*>", ""), F.lit("\n"))


def vocabulary(texts: DataFrame, html: DataFrame) -> DataFrame:
    """(word, n): words of three or more letters in lower case, halves of broken words and foreign markup left out.

    texts and html hold one column `text`. All of it stays inside the JVM, except for blocks with entities that only a table
    can read.
    """
    hard = F.col("text").contains("&") & F.col("text").rlike(OTHER_ENTITY)
    plain = html.where(~hard).select(without_tags(F.col("text")).alias("text"))
    read = F.col("text")
    for entity, sign in ENTITIES:
        read = F.replace(read, F.lit(entity), F.lit(sign))
    plain = plain.select(F.when(F.col("text").contains("&"), read).otherwise(F.col("text")).alias("text"))
    rest = C.arrow_rows(html.where(hard).select(without_tags(F.col("text")).alias("text")), lambda text: [(htmllib.unescape(text),)], "text string")
    every = texts.select("text").unionByName(plain).unionByName(rest)
    raw = every.select(F.explode(F.regexp_extract_all("text", F.lit(J_WORD), 1)).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    # case and invisible signs are taken off the kinds of words, not off the text
    word = F.lower(F.translate("word", J_UNSEEN, ""))
    return raw.select(word.alias("word"), "n").where(F.length("word") >= 3).groupBy("word").agg(F.sum("n").alias("n"))


#: A sign before or behind a letter.
SIGN = re.compile(r"[0-9@!+|$€](?:(?=[^\W\d_])|(?<=[^\W\d_].))")


#: Words of more signs, readings or letters than these are compared with the vocabulary instead of being spelled out.
MOST_SIGNS, MOST_READINGS, MOST_PLACES, MOST_LETTERS = 4, 64, 4, 40


def options_of(word: str) -> list[str]:
    """Of each character of the word the letters it may stand for."""
    cyr = any("а" <= c <= "я" or c == "ё" for c in word)
    return ["".join(x for x in SIGNS[c] if ("а" <= x <= "я" or x == "і") == cyr) if c in SIGNS else c for c in word]


def readings(word: str) -> set[str] | None:
    """Words that may have been printed where this one was read: letters for its signs, and in any places one kind of
    letters read for others. None if they are too many to be spelled out."""
    if sum(c in SIGNS for c in word) > MOST_SIGNS or len(word) > MOST_LETTERS:
        return None
    bases = {""}
    for options in options_of(word):
        bases = {b + x for b in bases for x in options}
        if len(bases) > MOST_READINGS:
            return None
    out = {b for b in bases if b != word}
    for base in bases:
        for read, printed in LETTERS:
            places = [m.start() for m in re.finditer(f"(?={read})", base)]
            if len(places) > MOST_PLACES:
                return None
            for k in range(1, len(places) + 1):
                for some in combinations(places, k):
                    if any(b - a < len(read) for a, b in zip(some, some[1:])):
                        continue
                    s, last = [], 0
                    for p in some:
                        s += [base[last:p], printed]
                        last = p + len(read)
                    out.add("".join(s) + base[last:])
    if word[-1:] in "!+|" and len(word) > 3:
        out.add(word[:-1])
    out.discard(word)
    return out


def reads_as(word: str, printed: str) -> bool:
    """printed is among the readings of word, found by walking both."""
    if word == printed:
        return False
    if word[-1:] in "!+|" and len(word) > 3 and word[:-1] == printed:
        return True
    options = options_of(word)
    n = len(word)
    for read, new in [("", ""), *LETTERS]:
        # places in printed that can be reached with the first i characters of the word
        at: list[set[int]] = [set() for _ in range(n + len(read) + 1)]
        at[0].add(0)
        for i in range(n):
            for j in at[i]:
                if j < len(printed) and printed[j] in options[i]:
                    at[i + 1].add(j + 1)
                if read and i + len(read) <= n and printed.startswith(new, j) and all(c in options[i + k] for k, c in enumerate(read)):
                    at[i + len(read)].add(j + len(new))
        if len(printed) in at[n]:
            return True
    return False


#: Letters that look like two others, and one letter for all that may stand for each other: equal for a word and its readings.
WIDE = {printed: read for read, printed in LETTERS if len(read) == 2}


def classes() -> dict[str, str]:
    parent: dict[str, str] = {}

    def top(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for a, b in [(sign, c) for sign, those in SIGNS.items() for c in those] + [(a, b) for a, b in LETTERS if len(a) == len(b) == 1]:
        for c in WIDE.get(b, b):
            parent[top(c)] = top(a)
    return {c: top(c) for c in list(parent)}


CLASS = classes()
RUN = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    return RUN.sub(r"\1", "".join(CLASS.get(c, c) for x in word for c in WIDE.get(x, x)))


ROMAN = re.compile(r"[ivxlcdmw]+")


def misreadings(words: DataFrame, there: DataFrame, ratio: int = RATIO, least: int = LEAST) -> DataFrame:
    """(word, printed): those of `words` (word, n) that are a far more frequent word of `there` (word, n) misread."""

    def run(word, n):
        alpha = word.isalpha()
        if len(word) > (3 if alpha else 2):
            most = n * (ratio if alpha else 2)
            if (some := readings(word)) is None:
                for key in {shape(word), shape(word[:-1])}:
                    yield word, None, key, most
            else:
                for r in some:
                    if r.isalpha() and not ROMAN.fullmatch(r):
                        yield word, r, None, most

    asked = C.cut(C.arrow_rows(words.select("word", "n"), run, "word string, printed string, shape string, most bigint"))
    frequent = there.where(F.col("n") >= least).select(F.col("word").alias("printed"), F.col("n").alias("there"))
    hit = asked.where("printed is not null").drop("shape").join(frequent, "printed")
    # words of too many readings meet the frequent words of their shape, and are compared with each
    shaped = C.arrow_rows(frequent, lambda printed, n: [(printed, n, shape(printed))], "printed string, there bigint, shape string")
    pairs = asked.where("printed is null").drop("printed").join(shaped, "shape").where("there >= most").select("word", "printed", "most", "there").distinct()
    kept = C.arrow_rows(pairs, lambda word, printed, most, n: [(printed, word, most, n)] if printed.isalpha() and not ROMAN.fullmatch(printed) and reads_as(word, printed) else [], "printed string, word string, most bigint, there bigint")
    hit = hit.unionByName(kept).where(F.col("there") >= F.col("most"))
    best = hit.groupBy("word").agg(F.max(F.struct("there", "printed")).alias("best"))
    # a word and its own exclamation or plus sign aren't one misread
    return best.select("word", F.col("best.printed").alias("printed")).where("not (length(word) = length(printed) + 1 and startswith(word, printed))")


def common_words(words: DataFrame, wrong: DataFrame, bound: int = C.VOCABULARY_BOUND) -> set[str]:
    """At most `bound` of the most frequent right words: enough to skip nearly all of a text without a look-up."""
    right = words.where("n >= 3").join(wrong.select("word"), "word", "left_anti")
    return {r.word for r in right.orderBy(F.desc("n"), "word").limit(bound).select("word").toLocalIterator()}


def candidates(records: DataFrame, field: str, known) -> DataFrame:
    """Kinds that the record shows by itself, and words to be looked up: (field_name, rec_id, kind, word, other, n).

    n counts a word with signs in it or broken over a line end, which the vocabulary doesn't hold. The text of html comes from
    without_tags.
    """

    def run(field_name, rec, value, known, fine):
        text, has = kept(field, value)
        for kind in sorted(has):
            yield field_name, rec, kind, None, None, None
        text = UNSEEN.sub("", text) if has_unseen(text) else text
        low = text.lower()
        ends = hyphens(text)
        for m in BROKEN.finditer(text) if ends else ():
            a, sign, b = m[1], m[2], m[3]
            if b.lower() in SUSPENDED and sign == "-" or b[0].isupper() and not a.isupper():
                continue
            # without the whole word in the vocabulary only a plain hyphen in a readable line counts
            start = text.rfind("\n", 0, m.start()) + 1
            plain = sign == "-" and junk_share(text[start : m.start(2)]) < 0.4
            yield field_name, rec, "hyphen", (a + b).lower(), b.lower() if plain else None, None
            if (a + b).lower() not in known:
                yield field_name, rec, "misread", (a + b).lower(), None, 1
        signed = bool(SIGN.search(low))
        if signed and ends:
            for a, b in BROKEN_MIXED.findall(low):
                if not (a + b).isalpha() and MIXED.fullmatch(a + b):
                    yield field_name, rec, "misread", a + b, None, 1
        low = without_marks(low)
        # stretches without a space that have known words only are remembered
        odd = set()
        for x in set(low.split()) - fine:
            if others := [w for w in LONG.findall(x) if w not in known]:
                odd.update(others)
            elif len(fine) < C.VOCABULARY_BOUND:
                fine.add(x)
        signed = signed and bool(SIGN.search(low))
        if odd or signed:
            low = readable(low, odd, signed)
            odd = {w for w in odd if w in low}
            for w in odd:
                yield field_name, rec, "misread", w, None, None
            if signed:
                for w, n in Counter(w for w in MIXED.findall(low) if len(w) > 2 and not w.isalpha()).items():
                    yield field_name, rec, "misread", w, None, n

    return C.arrow_rows(C.narrow(records), run, CANDIDATES, lambda: (known.value, set()))


def block_edges(blocks: DataFrame) -> DataFrame:
    """Headers and page numbers among the blocks of a result, by the edges of its pages."""
    flow = blocks.where(F.col("block_type").isin("Text", "TextInlineMath", "Caption", "Footnote") & ~F.col("html").rlike("<(?:pre|math|table|ul|ol)") & F.col("page_id").isNotNull())
    flow = flow.select("block_key", "result_id", "page_id", "block_id", F.explode(F.array(F.btrim(without_tags(F.col("html")), F.lit(" \t\n")))).alias("line")).where("line <> '' and not contains(line, '\n')")
    # (a filter doesn't go below explode, where it would read the tags again); short blocks and long ones are ranked apart, so the one doesn't hide the other; deliveries of one block share its rank
    long = F.length("line") > LONG_LINE
    page = Window.partitionBy("result_id", "page_id", long)
    first = F.dense_rank().over(page.orderBy("block_id", "block_key"))
    last = F.dense_rank().over(page.orderBy(F.desc("block_id"), F.desc("block_key")))
    edge = flow.withColumn("first", first).withColumn("last", last).where((F.col("first") <= EDGE) | (F.col("last") <= EDGE))
    # a file's list holds at most 4 * EDGE lines a page
    files = edge.groupBy("result_id").agg(F.array_sort(F.collect_set(F.struct("page_id", "block_id", "block_key", "line"))).alias("lines"))

    def run(result, lines):
        headers, numbers = edges([(x["block_key"], x["page_id"], htmllib.unescape(x["line"]).strip(), "") for x in lines], True)
        for found_keys, kind in ((headers, "header"), (numbers, "pageno")):
            for k in sorted(found_keys):
                yield "html", k, kind

    return C.arrow_rows(files, run, "field_name string, rec_id bigint, kind string")


def noise(bodies: DataFrame, checks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(field_name, rec_id, kind, word, printed): every kind of noise of every record, with the words concerned."""
    html = C.record(blocks, "block_key", "html", "html")
    parts = [("body", bodies), ("texts", checks.withColumnRenamed("texts", "text")), ("html", html.withColumn("text", without_tags(F.col("text"))))]
    pages = checks.select(F.explode("texts").alias("text")).where("text is not null")
    words = C.cut(vocabulary(bodies.select("text").unionByName(pages), html.select("text")))
    wrong = C.cut(misreadings(words, words))
    known = words.sparkSession.sparkContext.broadcast(frozenset(common_words(words, wrong)))
    cand = None
    for field, df in parts:
        one = candidates(df, field, known)
        cand = one if cand is None else cand.unionByName(one)
    cand = C.cut(C.once(cand))
    plain = cand.where("kind in ('header', 'pageno')").select("field_name", "rec_id", "kind", "word", F.lit(None).cast("string").alias("printed"))
    signed = cand.where("kind = 'misread' and n is not null").groupBy("word").agg(F.sum("n").alias("n"))
    wrong = wrong.unionByName(misreadings(signed.join(wrong.select("word"), "word", "left_anti"), words))
    misread = cand.where("kind = 'misread'").join(wrong, "word").select("field_name", "rec_id", "kind", "word", "printed")
    # a broken word: the vocabulary has it whole, or what it is a misreading of, or else doesn't have its second half
    broken = cand.where("kind = 'hyphen'")
    entire = words.where("n >= 2").select("word").unionByName(wrong.select("word")).distinct()
    whole = broken.join(entire.withColumn("is_word", F.lit(True)), "word", "left")
    half = words.where("n >= 2").select(F.col("word").alias("other"), F.lit(True).alias("half_word"))
    hyphen = whole.where("is_word").unionByName(whole.where("is_word is null and other is not null").join(half, "other", "left_anti").select(*whole.columns))
    hyphen = hyphen.select("field_name", "rec_id", "kind", "word", F.col("word").alias("printed"))
    edge = block_edges(blocks).select("field_name", "rec_id", "kind", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("printed"))
    return plain.unionByName(misread).unionByName(hyphen).unionByName(edge)


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return C.bodies(spark, sf_dir), C.check_texts(spark, sf_dir), C.table(spark, sf_dir, "block_outputs").where("block_key is not null and html is not null")


#: A line at which a paragraph doesn't go on: headings, rows, quotes, list marks, fences, tags, underlines, blocks set aside.
OWN_LINE = re.compile(r"[ \t]*(?:#{1,6}\s|={2,}|\\(?:(?:sub)*section|chapter|begin|end|item)\b|[|>\x00]|[-*+•–—▪●○]\s|\(?\d{1,4}[.)]\s|```|~~~|\$\$|</?[A-Za-z!]|[-=]{2,}[ \t]*$)")
#: A line after which the paragraph doesn't go on: rows, headings and tags of other markups, blocks set aside.
CLOSED = re.compile(r"[|>\x00]$|^[ \t]*={2,}.*={2,}$|^[ \t]*\\[A-Za-z]+\*?\{[^{}]*\}$")
#: What stands for a line that was taken out: blank, but told from the blank lines of the text.
GONE = " \t "
#: Block, and inline, that is kept as it stands.
BLOCK, INLINE = "\x00", "\x01"


class Seen:
    """A text as it is searched, each of its characters with what stands for it in the record and what follows that unseen.

    Edits are found in `text` and made in both, so code, formulas and tags come out as they were.
    """

    def __init__(self, text: str, source: list[str], tails: dict[int, str]):
        self.text, self.source, self.tails = text, source, tails

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Put other characters in place of [a, b); edits in order, apart from each other. Tags inside are kept."""
        if not edits:
            return
        text, source, tails, at, n = [], [], {}, 0, 0
        old = sorted(self.tails.items())
        k = 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            while k < len(old) and old[k][0] < a:
                tails[n + old[k][0] - at] = tails.get(n + old[k][0] - at, "") + old[k][1]
                k += 1
            text += [self.text[at:a], new]
            source += self.source[at:a]
            source += new
            n += a - at + len(new)
            while k < len(old) and old[k][0] < b:
                if rest := UNSEEN.sub("", old[k][1]):
                    tails[n - 1] = tails.get(n - 1, "") + rest
                k += 1
            at = b
        self.text, self.source, self.tails = "".join(text), source, tails

    def whole(self) -> str:
        if not self.tails:
            return "".join(self.source)
        return self.tails.get(-1, "") + "".join(c + self.tails[i] if i in self.tails else c for i, c in enumerate(self.source))


def guarded(text: str) -> str:
    """A body with code and formulas blanked, their line ends too: blocks by one sign, what stands inside of lines by another."""

    def one(m: re.Match) -> str:
        return (INLINE if m.re is INLINE_CODE or m.group()[:2] == "\\(" or m.group()[0] == "$" != m.group()[1:2] else BLOCK) * len(m.group())

    if "```" in text or "~~~" in text:
        text = FENCED.sub(one, text)
    if "`" in text:
        text = INLINE_CODE.sub(one, text)
    return FORMULA.sub(one, text) if "$" in text or "\\" in text else text


def without_unseen(text: str, source: str) -> Seen:
    """Invisible signs of the text are set aside; those of code and formulas are hidden already."""
    if not UNSEEN.search(text):
        return Seen(text, list(source), {})
    out, tails = [], {}
    for c, s in zip(text, source):
        if UNSEEN.match(c):
            tails[len(out) - 1] = tails.get(len(out) - 1, "") + s
        else:
            out.append((c, s))
    return Seen("".join(c for c, _ in out), [s for _, s in out], tails)


def seen(field: str, value) -> Seen:
    """A record without its headers and page numbers, as it is searched for broken and misread words."""
    if field == "body":
        masked = value
        for rule, signs in ((FENCED, ("```", "~~~")), (INLINE_CODE, ("`",)), (FORMULA, ("$", "\\"))):
            if any(x in masked for x in signs):
                masked = blanked(rule, masked)
        lines, cand, paged = body_lines(masked)
        headers, numbers = edges(cand, paged) if cand else (set(), set())
        gone = headers | numbers | {i for i, x in enumerate(lines) if x.startswith("<!--") and MARK.match(x) or "[page " in x and LOST.match(x)}
        text, source = guarded(value), value
    else:
        pages, cand = text_lines(value)
        headers, numbers = edges(cand, True)
        lines = [x for page in pages for x in page]
        gone = headers | numbers
        text = source = "\n".join(lines)
    if gone:
        parts, origin, at = [], [], 0
        for i, x in enumerate(lines):
            if i in gone:
                parts.append(GONE)
                origin.append(GONE)
            else:
                parts.append(text[at : at + len(x)])
                origin.append(source[at : at + len(x)])
            at += len(x) + 1
            if i + 1 < len(lines):
                # a line end inside of code or a formula is hidden
                parts.append(text[at - 1])
                origin.append("\n")
        text, source = "".join(parts), "".join(origin)
    return without_unseen(text, source)


PIECE = re.compile(rf"(?P<own><(?P<name>pre|math|code)\b(?P<how>[^>]*)>.*?</(?P=name)>)|(?P<block>{BLOCK_TAG.pattern})|{TAG.pattern}|&(?:#\d+;?|#[xX][\da-fA-F]+;?|[^\t\n\f <&#;]{{1,32}};?)", re.S | re.I)
BREAK = re.compile(r"<br\s*/?>", re.I)
TAG_NAME = re.compile(r"<(/?)([A-Za-z][\w-]*)")


def seen_html(markup: str) -> Seen:
    """What a reader sees of a block, with the markup that stands for it; inline tags are unseen."""
    text, source, tails, at = [], [], {}, 0

    def put(signs: str, stand: list[str]) -> None:
        for c, x in zip(signs, stand):
            if UNSEEN.match(c):
                tails[len(text) - 1] = tails.get(len(text) - 1, "") + x
            else:
                text.append(c)
                source.append(x)

    for m in PIECE.finditer(markup):
        put(plain := markup[at : m.start()], plain)
        at = m.end()
        piece = m.group()
        if m["own"]:
            put(BLOCK if m["name"].lower() == "pre" or "block" in m["how"] else INLINE, [piece])
        elif m["block"]:
            put("\n", [piece])
        elif piece[0] == "&":
            signs = htmllib.unescape(piece)
            put(signs, [piece] if len(signs) == 1 else [htmllib.escape(c, quote=False) for c in signs])
        else:
            tails[len(text) - 1] = tails.get(len(text) - 1, "") + piece
    put(plain := markup[at:], plain)
    return Seen("".join(text), source, tails)


def structure(source: list[str]) -> list[str]:
    """The block tags among what stands for some characters."""
    return [x for x in source if x[0] == "<" and not BREAK.fullmatch(x)]


def closed(tags: list[str]) -> bool:
    """The tags close blocks and open the same again, so without them the markup stays whole."""
    names = [TAG_NAME.match(x).groups() for x in tags]
    half = len(names) // 2
    return len(names) == 2 * half and all(a == "/" and b == "" and x.lower() == y.lower() for (a, x), (b, y) in zip(names[:half], reversed(names[half:])))


def joined_words(s: Seen, joined: set[str]) -> None:
    edits = []
    for m in BROKEN.finditer(s.text) if joined and hyphens(s.text) else ():
        if (m[1] + m[3]).lower() in joined:
            tags = structure(s.source[m.end(1) : m.start(3)])
            # the second half goes up where the tags between have to stay
            edits += [(m.end(1), m.start(3), "")] if not tags or closed(tags) else [(m.end(1), m.end(2), m[3]), (*m.span(3), "")]
    s.edit(edits)


def spelled_words(s: Seen, spelled: dict[str, str]) -> None:
    """Misread words as printed, found as the vocabulary finds them; targets, paths and tags of foreign markup stay."""
    for rule in (MIXED, LONG) if spelled else ():
        aside = [m.span() for m in RESIDUE.finditer(s.text)]
        edits = []
        for m in rule.finditer(s.text):
            w = m.group()
            right = spelled.get(w.lower())
            if right is None or any(a < m.end() and m.start() < b for a, b in aside):
                continue
            letters = [c for c in w if c.isalpha()]
            right = right.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else right[:1].upper() + right[1:] if w[:1].isupper() else right
            edits.append((*m.span(), right))
        s.edit(edits)


def paragraphs(s: Seen, markup: bool = False) -> None:
    """Line breaks inside of a paragraph become spaces; lists, tables, headings and blocks set aside keep theirs."""
    lines = s.text.split("\n")
    starts, at = [], 0
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    filled = [i for i, x in enumerate(lines) if x.strip()]
    kinds, _ = line_kinds([lines[i].rstrip() for i in filled], False)
    edits = []
    for (i, a), (j, b) in zip(zip(filled, kinds), zip(filled[1:], kinds[1:])):
        x, y = lines[i].rstrip(), lines[j].lstrip()
        if a != PROSE or b != PROSE or CLOSED.search(x) or HEAD.match(x) or OWN_LINE.match(y):
            continue
        span = starts[i] + len(x), starts[j] + len(lines[j]) - len(y)
        if markup:
            between = s.source[slice(*span)]
            # a tag for a break and the line end behind it are one break
            goes_on = not structure(between) and len(re.findall(r"<br\s*/?>[ \t]*\n?|\n", "".join(between), re.I)) == 1
        else:
            # over a page end only a sentence that isn't over goes on
            goes_on = j == i + 1 or GONE in lines[i + 1 : j] and not SENTENCE_END.search(x) and x[-1] != ":" and y[0].islower()
        if goes_on:
            edits.append((*span, " "))
    s.edit(edits)
    if not markup:
        s.edit([(m.start(), m.end(), "\n\n" if m.start() and m.end() < len(s.text) else "") for m in re.finditer(r"\A(?:[ \t]*\n)+|(?:\n[ \t]*)+\Z|\n[ \t]*(?:\n[ \t]*)*\n", s.text)])


def repaired(field: str, value, spelled: dict[str, str], joined: set[str]) -> str:
    """The record as continuous paragraphs: no headers and page numbers, broken words whole, misread words as printed."""
    if field == "html" and not spelled and not joined and "\n" not in value and not BREAK.search(value):
        return value
    s = seen_html(value) if field == "html" else seen(field, value)
    joined_words(s, joined)
    spelled_words(s, spelled)
    paragraphs(s, field == "html")
    return s.whole()


def repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, rec_id, clean) of all bodies, checks and blocks with some text; a block that is a header or a page number is empty."""
    b, c, h = inputs(spark, sf_dir)
    hits = F.when(F.col("field_name") == "html", F.col("kind").isin("header", "pageno")) | F.col("word").isNotNull()
    by = noise(b, c, h).groupBy("field_name", "rec_id").agg(F.collect_set(F.when(hits, F.struct("kind", "word", "printed"))).alias("words"))
    html = C.record(h, "block_key", "html", "html")
    out = None
    for df in (C.once(b, "rec_id").withColumn("texts", F.array("text")), C.once(c, "rec_id"), C.once(html, "rec_id").withColumn("texts", F.array("text"))):

        def run(field, rec, texts, words):
            if not any(texts):
                return
            words = words or []
            spelled = {w["word"]: w["printed"] for w in words if w["kind"] == "misread"}
            joined = {w["word"] for w in words if w["kind"] == "hyphen"}
            dropped = field == "html" and any(w["kind"] in ("header", "pageno") for w in words)
            yield field, rec, "" if dropped else repaired(field, texts if field == "texts" else texts[0], spelled, joined)

        one = C.arrow_rows(df.join(by, ["field_name", "rec_id"], "left").select("field_name", "rec_id", "texts", "words"), run, "field_name string, rec_id bigint, clean string")
        out = one if out is None else out.unionByName(one)
    return out


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(*inputs(spark, sf_dir)).select("field_name", "rec_id", "kind").distinct()
