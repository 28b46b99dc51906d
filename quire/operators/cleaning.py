"""The cleaning chain over one body: ordered passes over lines, as an Arrow kernel per document.

A segment is [line, protected]. Passes change, drop or add plain lines only; their order is the semantics. The chain settles:
cleaning a clean body changes nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators import formulas, grids, headings, lists, prose
from quire.operators.zones import is_underline, segments

HEADING = re.compile(r"^( {0,3})(#{1,6})[ \t]+(\S.*)$")
ITEM = re.compile(r"^\s*(?:[-*+]|\d{1,9}[.)])[ \t]+\S")
ROW = re.compile(r"^\s*\|.*\|\s*$")
RULE = re.compile(r"^[|:\- \t]*-[|:\- \t]*$")
MARK = re.compile(r"^<!-- source:page \d+ -->$")
NOISE = re.compile("[­​-‍﻿]")
WORD = re.compile(r"[^\W\d_]+")
LATIN_LIKE = "aceopxyABCEHKMOPTXyk"
CYRILLIC_LIKE = "асеорхуАВСЕНКМОРТХук"
CYRILLIC, LATIN = re.compile("[Ѐ-ӿ]"), re.compile("[A-Za-z]")
TO_LATIN = str.maketrans(CYRILLIC_LIKE, LATIN_LIKE)
TO_CYRILLIC = str.maketrans(LATIN_LIKE, CYRILLIC_LIKE)
ROUNDS = 8

Segments = list[list]


def each_plain(segs: Segments, fix) -> Segments:
    return [[x if p else fix(x), p] for x, p in segs]


def fix_line(line: str) -> str:
    """A rule is tried only where a sign of it stands in the line."""
    line = NOISE.sub("", line).rstrip()
    if not line:
        return line
    if "![" in line:
        line = re.sub(r"!\[[^\]\n]*[\w-]\.(?:png|jpe?g|gif|svg|tiff?|webp|bmp)\]\(", "![](", line)
    if "**" in line:
        line = re.sub(r"(?<=[^\W\d_])\*\*([^\W\d_]+)\*\*", r"\1", re.sub(r"\*\*([^\W\d_]+)\*\*(?=[^\W\d_])", r"\1", line))
        line = re.sub(r"^(\s*[-*+] \*\*\d+[.)]\*\*)(?=\S)", r"\1 ", line)
    if ". " in line or "II" in line or "V" in line or "X" in line:
        line = prose.decimals_joined(prose.roman_joined(re.sub(r"^(\d+)\. (\d+)\.(?=\s)", r"\1.\2.", line)))
    if "<span" in line:
        line = re.sub(r"<span id=[^<>]*></span>", "", line)
    if "](#" in line:
        line = re.sub(r"(?<!!)\[([^\]\n]+)\]\(#[^()\s]*\)", r"\1", line)
    if "•" in line:
        line = re.sub(r"^( {0,3})•[ \t]+(?=\S)", r"\1- ", line)
    # only a word of both scripts can have a letter of the wrong one
    return WORD.sub(one_script, line) if CYRILLIC.search(line) and LATIN.search(line) else line


def one_script(m: re.Match) -> str:
    """Look-alikes of another script inside a word whose other letters are of one script."""
    word = m.group()
    cyr = [c for c in word if "Ѐ" <= c <= "ӿ"]
    if not cyr or len(cyr) == len(word):
        return word
    sure_cyr = any(c not in CYRILLIC_LIKE for c in cyr)
    sure_lat = any(c.isascii() and c not in LATIN_LIKE for c in word)
    return word if sure_cyr == sure_lat else word.translate(TO_CYRILLIC if sure_cyr else TO_LATIN)


def drop_junk(segs: Segments) -> Segments:
    out = []
    for i, (line, protected) in enumerate(segs):
        core = line.strip()
        if not protected and len(core) >= 2 and not any(c.isalnum() for c in core):
            structural = RULE.match(core) or re.fullmatch(r"([-*_])(?: *\1){2,}", core) or core == "$$" or i and is_underline(line, segs[i - 1][0]) or re.fullmatch(r"\\+", core) or re.fullmatch(r"\|[\s|]*\|", core)
            if not structural:
                continue
        out.append([line, protected])
    return out


def fix_headings(segs: Segments) -> Segments:
    """No emphasis around titles, no ornaments before numbers, run-in text set apart, oversize headings as paragraphs."""
    out: Segments = []
    for line, protected in segs:
        m = None if protected else HEADING.match(line)
        if not m:
            out.append([line, protected])
            continue
        title = re.sub(r"^(\*\*|__)([^*_]+)\1$", r"\2", m[3].rstrip())
        title = re.sub(r"^[^\w\s§№#*_`$(\[<!«\"'„“+-]+\s*(?=\d)", "", title)
        if len(line) > 200:
            out.append([title, False])
            continue
        run = re.match(r"^(\d+(?:\.\d+)*\.? [^.!?]{1,56}[^\W\d_]{4})\. ([^\W\d_].*\s[a-zß-ÿа-яё].*)$", title)
        if run:
            out += [[f"{m[1]}{m[2]} {run[1]}", False], ["", False], [run[2], False]]
        else:
            out.append([f"{m[1]}{m[2]} {title}", False])
    return out


def heading_rows(segs: Segments) -> list[tuple[int, int, str]]:
    return [(i, len(m[2]), m[3]) for i, (x, p) in enumerate(segs) if not p and (m := HEADING.match(x))]


def level_numbered(segs: Segments, settled: set[int]) -> Segments:
    """One level per depth of numbering, from the depth most headings have; headings that the contents settled are the evidence
    where there are any."""
    rows = [(i, level, m[1].rstrip(".").count(".") + 1) for i, level, title in heading_rows(segs) if (m := re.match(r"(\d+(?:\.\d+)*\.?)\s", title))]
    if len(rows) < 2:
        return segs
    by: dict[int, Counter] = {}
    for _, level, depth in [r for r in rows if r[0] in settled] or rows:
        by.setdefault(depth, Counter())[level] += 1
    top = min(by)
    deep = [d for d in by if d >= 2 and sum(by[d].values()) >= 3]
    anchor = min(deep) if deep else min(by, key=lambda d: (-sum(by[d].values()), d))
    usual = min(by[anchor], key=lambda v: (-by[anchor][v], v))
    base = min(max(1, usual - (anchor - top)), max(1, 6 - (max(d for _, _, d in rows) - top)))
    for i, _, depth in rows:
        if i in settled:
            continue
        level = min(6, base + depth - top)
        segs[i] = [re.sub(r"#{1,6}", "#" * level, segs[i][0], count=1), False]
    return segs


def close_levels(segs: Segments) -> Segments:
    """Levels nobody uses are closed, from the shallowest used one on."""
    rows = heading_rows(segs)
    used = sorted({level for _, level, _ in rows})
    new = {v: used[0] + k for k, v in enumerate(used)}
    for i, level, _ in rows:
        if new[level] != level:
            segs[i] = [re.sub(r"#{1,6}", "#" * new[level], segs[i][0], count=1), False]
    return segs


def drop_running_headings(segs: Segments) -> Segments:
    """A heading that restates the numbered one still open at its level."""
    opened: dict[int, str] = {}
    gone = set()
    for i, level, title in heading_rows(segs):
        key = " ".join(WORD.findall(title.casefold()))
        number = re.match(r"\d[\d.]*", title)
        old = opened.get(level)
        if old is not None and old == (number[0] if number else "", key) and number:
            gone.add(i)
            continue
        for deeper in [v for v in opened if v >= level]:
            del opened[deeper]
        opened[level] = (number[0] if number else "", key)
    return [s for i, s in enumerate(segs) if i not in gone]


def cells(line: str) -> list[str]:
    core = re.sub(r"\|\s*$", "", re.sub(r"^\s*\|", "", line))
    return [c.strip() for c in re.split(r"(?<!\\)\|", core)]


def row(values: list[str]) -> str:
    return "| " + " | ".join(values) + " |"


def tables(segs: Segments) -> Segments:
    """Stacked rows apart, empty columns out, a table without body as text, a continued one joined to its start."""
    out: Segments = []
    i, last_head, last_end = 0, None, -1
    while i < len(segs):
        j = i
        while j < len(segs) and not segs[j][1] and ROW.match(segs[j][0]):
            j += 1
        if j - i < 2 or not RULE.match(segs[i + 1][0]):
            out += segs[i : max(j, i + 1)]
            i = max(j, i + 1)
            continue
        head, body = cells(segs[i][0]), [cells(s[0]) for s in segs[i + 2 : j]]
        rule = cells(segs[i + 1][0])
        if not body:
            out += [[" ".join(c for c in head if c), False]]
            i = j
            continue
        width = len(head)
        apart = []
        for r in body:
            pieces = [re.split(r"\s*<br\s*/?>\s*", c) for c in r]
            n = len(pieces[0])
            full = [p for p in pieces if p != [""]]
            if n >= 2 and len(full) >= 3 and all(len(p) == n and all(p) for p in full) and not any(x[:1].islower() or x[:1] == "(" for p in full for x in p[1:]):
                apart += [[p[k] if p != [""] else "" for p in pieces] for k in range(n)]
            else:
                apart.append(r)
        if len(rule) == width and all(len(r) == width for r in apart) and width > 1:
            keep = [k for k in range(width) if head[k] or any(r[k] for r in apart)]
            if keep and len(keep) < width:
                head, rule, apart = [head[k] for k in keep], [rule[k] for k in keep], [[r[k] for k in keep] for r in apart]
        between = out[last_end:] if last_end >= 0 else None
        if between is not None and head == last_head and all(not s[1] and (not s[0].strip() or MARK.match(s[0])) for s in between):
            marks = [s for s in between if s[0].strip()]
            out = out[:last_end] + [[row(r), False] for r in apart]
            last_end = len(out)
            out += [["", False], *marks] if marks else []
        else:
            out += [[row(head), False], [row(rule), False], *[[row(r), False] for r in apart]]
            last_head, last_end = head, len(out)
        i = j
    return out


def in_display(segs: Segments) -> list[bool]:
    """Lines of display formulas, their signs included."""
    out, dollars = [], 0
    for line, protected in segs:
        own = 0 if protected else line.count("$$")
        out.append(own > 0 or dollars % 2 == 1)
        dollars += own
    return out


def trim_repeats(segs: Segments, least: int = 3) -> Segments:
    """Of runs of equal blocks, then of equal lines within a block, one copy stays; tables and display formulas are left alone."""
    inner = in_display(segs)
    groups: list[list[int]] = []
    blank = lambda i: not segs[i][1] and not segs[i][0].strip()
    for i in range(len(segs)):
        if not groups or blank(i) != blank(groups[-1][0]):
            groups.append([])
        groups[-1].append(i)
    text = ["\n".join(segs[i][0] for i in g) for g in groups]
    fixed = [any(segs[i][1] or inner[i] or ROW.match(segs[i][0]) for i in g) for g in groups]
    kept: list[int] = []
    k = 0
    while k < len(groups):
        j = k + 2
        while j < len(groups) and text[j] == text[k] and text[k].strip() and not fixed[k] and not fixed[j]:
            j += 2
        kept += groups[k]
        k = j - 1 if (j - k) // 2 >= least else k + 1
    out: Segments = []
    i = 0
    while i < len(kept):
        j = i + 1
        line, protected = segs[kept[i]]
        while j < len(kept) and not protected and line.strip() and not inner[kept[i]] and segs[kept[j]] == [line, False] and not inner[kept[j]] and not ROW.match(line):
            j += 1
        out += [segs[k] for k in (kept[i : i + 1] if j - i >= least else kept[i:j])]
        i = j
    return [[x if p or inner_span(x) else formulas.without_loops(cut_spans(x)), p] for x, p in out]


def inner_span(line: str) -> bool:
    """Too short to hold a loop."""
    return len(line) < 18


def cut_spans(line: str) -> str:
    for a, b in reversed(formulas.repeated_spans(line)) if line.count("$") >= 12 else ():
        line = line[:a] + line[b:]
    return line


def rejoin_hyphens(segs: Segments) -> Segments:
    """A word broken over two lines is joined if the body has the word at least twice, and hyphenated on one line less than three times."""
    plain = [x for x, p in segs if not p]
    counts = Counter(w.lower() for x in plain for w in WORD.findall(x))
    hyphened = Counter(w.lower() for x in plain for w in re.findall(r"[^\W\d_]+-[^\W\d_]+", x))
    for i in range(len(segs) - 1):
        (a, p), (b, q) = segs[i], segs[i + 1]
        m, n = re.search(r"([^\W\d_]+)-$", a), re.match(r"\s*([^\W\d_]+)(\S*)(?:\s+|$)", b)
        if p or q or not m or not n or not n[1][0].islower():
            continue
        word = (m[1] + n[1]).lower()
        if counts[word] >= 2 and hyphened[f"{m[1]}-{n[1]}".lower()] < 3:
            segs[i] = [a[: m.start()] + m[1] + n[1] + n[2], False]
            segs[i + 1] = [b[n.end() :], False]
    return segs


def join_cut_paragraphs(segs: Segments) -> Segments:
    """A paragraph cut by a page mark: at least four words without a sentence end before it, lower case after it."""
    i = 0
    while i < len(segs):
        if not segs[i][1] and MARK.match(segs[i][0]):
            a = i - 1
            while a >= 0 and not segs[a][1] and not segs[a][0].strip():
                a -= 1
            b = i + 1
            while b < len(segs) and not segs[b][1] and not segs[b][0].strip():
                b += 1
            if a >= 0 and b < len(segs) and not segs[a][1] and not segs[b][1]:
                head, tail = segs[a][0], segs[b][0]
                plain = not any(r.match(x) for r in (HEADING, ITEM, ROW, MARK) for x in (head, tail))
                if plain and len(head.split()) >= 4 and re.search(r"[^\W\d_]$|,$", head) and re.match(r"[a-zß-ÿа-яё]", tail) and head.split()[-1].lower() != tail.split()[0].lower():
                    mark = segs[i]
                    segs[a : b + 1] = [[f"{head} {tail}", False], ["", False], mark]
                    i = a + 2
        i += 1
    return segs


def collapse_blanks(segs: Segments) -> str:
    out: list[str] = []
    for line, protected in segs:
        if protected or line.strip() or (out and out[-1] != ""):
            out.append(line if protected or line.strip() else "")
    text = "\n".join(out).strip("\n")
    return text + "\n" if text else ""


def levels(segs: Segments) -> Segments:
    """Heading levels: the printed contents first, numbers, number forms, what hangs below them, copies of a title, gaps."""
    segs = headings.lost(headings.unstyled(segs))
    settled = headings.outlined(segs, headings.records(segs))
    segs = headings.number_forms(level_numbered(segs, settled))
    segs = headings.voted(headings.nested(segs, settled), settled)
    return headings.gaps_closed(close_levels(segs), settled)


def one_round(text: str) -> str:
    segs = drop_junk(each_plain(segments(text), fix_line))
    segs = fix_headings(headings.spaced_titles(segs))
    segs = drop_running_headings(prose.without_furniture(headings.one_contents_heading(segs)))
    segs = formulas.mended(levels(segs))
    segs = lists.normalized(lists.without_stray_bullets(segs))
    segs = grids.repaired(grids.entries_whole(tables(grids.glued_headers(segs))))
    segs = rejoin_hyphens(segs)
    segs = prose.crushed_joined(prose.emphasis_dropped(segs))
    segs = prose.spaced_joined(join_cut_paragraphs(segs))
    segs = prose.tokens_repaired(prose.compounds_settled(segs))
    segs = formulas.stubs_cut(grids.laid_out(segs))
    return collapse_blanks(trim_repeats(segs))


def final_lines(segs: Segments) -> list[int | None]:
    """The line each segment has after blanks are collapsed; none for a blank that goes."""
    out: list[int | None] = []
    n, last = -1, ""
    end = max((i for i, (x, p) in enumerate(segs) if p or x.strip()), default=-1)
    for i, (line, protected) in enumerate(segs):
        blank = not protected and not line.strip()
        if i > end or blank and (n < 0 or last == ""):
            out.append(None)
            continue
        n, last = n + 1, "" if blank else line or " "
        out.append(n)
    return out


class Unsettled(ValueError):
    """The chain still changes a body after ROUNDS rounds."""


def cleaned(text: str) -> str:
    """The whole chain, repeated until it changes nothing; Unsettled if that takes more than ROUNDS rounds."""
    for _ in range(ROUNDS):
        new = one_round(text)
        if new == text:
            return text
        text = new
    raise Unsettled(f"still changing after {ROUNDS} rounds")


def clean(bodies: DataFrame) -> DataFrame:
    """(result_id, clean, error): a body that a pass can't take keeps its text and names the error."""
    out = pa.schema([("result_id", pa.int64()), ("clean", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, errors = [], []
            for body in batch.column(1).to_pylist():
                try:
                    text.append(cleaned(body) if body is not None else None)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 one document must not end the run
                    text.append(body)
                    errors.append(repr(e)[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(errors, pa.string())], schema=out)

    return bodies.select("result_id", "body").mapInArrow(run, "result_id bigint, clean string, error string")
