"""Zones a second model may mend, and the verdicts on what it gives back.

A zone is a stretch of a body with one defect. A reply for it stands only if it keeps what the zone holds: the words of crushed
paragraphs, the delimiters' surroundings of swallowed prose, the values of table rows, the titles of headings, the letters of
spaced words. Nothing is asked here; zones go out and replies come in as rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from quire.operators import findings, formulas, grids, headings, prose
from quire.operators.kernels import rows
from quire.operators.zones import segments

Segments = list[list]
TOKEN = re.compile(r"[^\W_]+")


def swallowed(segs: Segments) -> list[int]:
    """Lines whose display formula holds prose: four words or more of three letters outside of commands."""
    out = []
    for i, (line, protected) in enumerate(segs):
        content = None if protected else formulas.lone_display(line)
        if content and len(re.findall(r"(?<![\\A-Za-z])[^\W\d_]{3,}(?![A-Za-z{])", re.sub(r"\\[A-Za-z]+\s*\{[^{}]*\}", " ", content))) >= 4:
            out.append(i)
    return out


def broken_formulas(segs: Segments) -> list[int]:
    """Lines with a closed formula that isn't sound."""
    return [i for i, (line, p) in enumerate(segs) if not p and "$" in line and any(line[a:b].endswith("$") and not formulas.is_sound(formulas.inside(line[a:b])) for a, b in formulas.spans(line))]


def ladder_needs_repair(heads: list[tuple[int, str]]) -> bool:
    """A level is skipped on the way down, or one title stands on two levels; heads: (level, title) in order."""
    levels: dict[str, set] = {}
    for level, title in heads:
        levels.setdefault(headings.fold(title), set()).add(level)
    return any(b[0] > a[0] + 1 for a, b in zip(heads, heads[1:])) or any(len(v) > 1 for v in levels.values())


def zones(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, first line, last line, text) of all zones of a body, in the order they are mended: ladder, blocks, tables, spacing."""
    segs = segments(text)
    heads = headings.rows(segs)
    if ladder_needs_repair([(level, title) for _, level, title in heads]):
        yield "ladder", heads[0][0], heads[-1][0], "\n".join(f"{k + 1}. {'#' * level} {title}" for k, (_, level, title) in enumerate(heads))
    block = lambda a, b: "\n".join(s[0] for s in segs[a : b + 1])
    for run in prose.crushed_runs(segs):
        yield "crushed", run[0], run[-1], block(run[0], run[-1])
    for i in swallowed(segs):
        yield "swallowed", i, i, segs[i][0]
    for i in broken_formulas(segs):
        yield "formula", i, i, segs[i][0]
    bad = grids.collapsed(segs)
    for a, b in grids.blocks(segs):
        if any(i in bad for i in range(a, b)):
            yield "table", a, b - 1, block(a, b - 1)
    for i, (line, protected) in enumerate(segs):
        if not protected and "$" not in line and prose.SPACED.search(line):
            yield "spacing", i, i, line


def tokens(text: str) -> Counter:
    return Counter(t.casefold() for t in TOKEN.findall(text))


def joined_words(old: str, new: str) -> set[str]:
    """Words of the new text that are two neighbours of the old one, over a hyphen or a line end."""
    pairs = {(a + b).casefold() for a, b in re.findall(r"([^\W\d_]+)[-\s]+(?=([^\W\d_]+))", old)}
    return {w.casefold() for w in prose.WORD.findall(new)} & pairs


def block_verdict(kind: str, old: str, new: str | None, words: Counter) -> str | None:
    """Why a mended block is refused; null if it stands. words: counts of the body, by which joined words are attested."""
    if not new or not new.strip():
        return "empty"
    if new.strip() == old.strip():
        return "echo"
    if any(p for _, p in segments(new)):
        return "protected"
    if new.count("|") > old.count("|"):
        return "new bars"
    joined = joined_words(old, new)
    if any(words[w] == 0 for w in joined):
        return "word not attested"
    if kind == "crushed":
        a, b = tokens(old), tokens(new)
        for w in joined:
            a[w] += b[w] - a[w]
        lost, extra = a - b, b - a
        halves = Counter(h.casefold() for x, y in re.findall(r"([^\W\d_]+)[-\s]+(?=([^\W\d_]+))", old) for h in (x, y) if (x + y).casefold() in joined)
        if (lost - halves) or extra or sorted(formulas.inside(old[x:y]) for x, y in formulas.spans(old)) != sorted(formulas.inside(new[x:y]) for x, y in formulas.spans(new)):
            return "content changed"
    elif kind == "swallowed":
        bare = lambda x: re.sub(r"[\s$]|\\(?:text|mathrm|mathit|textrm)\s*|[{}~]|\\[,;:! ]", "", x)
        if bare(old) != bare(new):
            return "content changed"
    elif kind == "formula":
        if tokens(re.sub(r"\\[A-Za-z]+", " ", old)) != tokens(re.sub(r"\\[A-Za-z]+", " ", new)):
            return "content changed"
    if kind in ("swallowed", "formula") and not all(formulas.is_sound(formulas.inside(new[a:b])) for line in [new] for a, b in formulas.spans(line)):
        return "not sound"
    left = {k for _, k, _ in findings.of(new)} - {"letter-spacing"}
    return "finding left" if left else None


def row_verdict(old: str, new: str, width: int) -> str | None:
    """Why a row of a table is refused: another width than the table's, or values lost, added or in another order."""
    if not grids.ROW.match(new):
        return "no row"
    if len(grids.cells(new)) != width:
        return "wrong width"
    flat = lambda x: " ".join(c for c in grids.cells(x) if c).split()
    if Counter(flat(old)) != Counter(flat(new)):
        return "values changed"
    return "values moved" if flat(old) != flat(new) else None


def table_verdict(old: str, new: str | None) -> str | None:
    a, b = (old or "").split("\n"), (new or "").split("\n")
    if len(a) != len(b):
        return "rows changed"
    width = len(grids.cells(a[1])) if len(a) > 1 else 0
    return next((why for k, (x, y) in enumerate(zip(a, b)) if k != 1 and x != y and (why := row_verdict(x, y, width))), None)


def relevelled(heads: list[tuple[int, str]], reply: list[tuple[int, int, str]], stated: set[str] = frozenset()) -> tuple[list[int], list[str]]:
    """Levels after a reply (index, level, title), and why entries are refused. An entry moves one heading by two levels at most,
    unless its level is stated; entries that add a skip, split a title or empty a level that was in use are left out one by one."""
    levels = [level for level, _ in heads]
    refused = []

    def bad(now: list[int]) -> tuple[int, int, int]:
        skips = sum(b > a + 1 for a, b in zip(now, now[1:]))
        by: dict[str, set] = {}
        for level, (_, title) in zip(now, heads):
            by.setdefault(headings.fold(title), set()).add(level)
        return skips, sum(len(v) > 1 for v in by.values()), len({x for x, _ in heads} - set(now))

    start = bad(levels)
    entries = []
    for index, level, title in reply:
        if not 0 <= index < len(heads):
            refused.append("no such heading")
        elif headings.fold(title) != headings.fold(heads[index][1]):
            refused.append("other title")
        elif not 1 <= level <= 6:
            refused.append("no such level")
        elif abs(level - heads[index][0]) > 2 and headings.fold(title) not in stated:
            refused.append("too far")
        else:
            entries.append((index, level))
    whole = list(levels)
    for index, level in entries:
        whole[index] = level
    if all(a <= b for a, b in zip(bad(whole), start)):
        return whole, refused
    for index, level in entries:
        now = list(levels)
        now[index] = level
        if all(a <= b for a, b in zip(bad(now), start)):
            levels = now
        else:
            refused.append("regression")
    return levels, refused


def respaced(line: str, new: str) -> str | None:
    """The new line if it only closes blanks between single letters of the old one; else nothing."""
    if line.replace(" ", "") != new.replace(" ", ""):
        return None
    runs = [m.span() for m in prose.SPACED.finditer(line)]
    i = j = 0
    while i < len(line):
        if j < len(new) and line[i] == new[j]:
            i, j = i + 1, j + 1
        elif line[i] == " " and any(a <= i < b for a, b in runs):
            i += 1
        else:
            return None
    return new if j == len(new) else None


def body_zones(bodies: DataFrame) -> DataFrame:
    """(result_id, kind, first_line, last_line, text) of the zones of bodies (result_id, body)."""

    def run(result: int, body: str) -> Iterator[tuple]:
        for zone in zones(body):
            yield result, *zone

    return rows(bodies.where("body is not null").select("result_id", "body"), run, "result_id bigint, kind string, first_line int, last_line int, text string")
