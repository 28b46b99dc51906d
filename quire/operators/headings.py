"""Heading levels of a body: printed contents as a witness, number forms, lost and unstyled headings, votes, gaps.

Passes take and give segments ([line, protected]); they change the signs of headings only, but for the lines that become one.
Titles are compared by number and folded title.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

Segments = list[list]

HEADING = re.compile(r"^( {0,3})(#{1,6})[ \t]+(\S.*)$")
DOTTED = re.compile(r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$")
SUB = re.compile(r"^(\d+(?:\.\d+)+)\.?\s+(\S.*)$")
ROW = re.compile(r"^\s*\|.*\|\s*$")
MARK = re.compile(r"^<!-- source:page \d+ -->$")
#: Titles of printed contents, and of sections that stand beside all others (fixed values).
CONTENTS = frozenset(("contents", "table of contents", "inhalt", "inhaltsverzeichnis", "sommaire", "table des matières", "содержание", "оглавление"))
TOP = frozenset("appendix references bibliography index glossary anhang literatur literaturverzeichnis annexe annexes bibliographie приложение литература".split())
RANK = re.compile(r"^(part|book|chapter|section|teil|kapitel|abschnitt|partie|chapitre|часть|глава|раздел)\s+(\d+|[ivxlc]+)\b[.:]?\s*", re.I)
ENTRY = re.compile(r"^(.*?\S)\s*(?:\.{3,}|…+|(?:\s\.){3,}|\s{3,}|\t)\s*(\d+|[ivxlc]+)\s*$", re.I)


def fold(title: str) -> str:
    """One spelling of equal titles: no number, accents, case or punctuation at the edges."""
    title = re.sub(r"^\d+(?:\.\d+)*\.?\s+", "", title)
    plain = "".join(c for c in unicodedata.normalize("NFD", title) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w#]+", " ", plain.casefold()).split())


def rows(segs: Segments) -> list[tuple[int, int, str]]:
    """(place, level, title) of the headings."""
    return [(i, len(m[2]), m[3].rstrip()) for i, (x, p) in enumerate(segs) if not p and (m := HEADING.match(x))]


def relevel(segs: Segments, i: int, level: int) -> None:
    segs[i] = [re.sub(r"#{1,6}", "#" * max(1, min(6, level)), segs[i][0], count=1), False]


def number_of(title: str) -> tuple[int, ...]:
    m = DOTTED.match(title)
    return tuple(int(x) for x in m[1].split(".")) if m else ()


# Letter spacing


def spaced_titles(segs: Segments) -> Segments:
    """`I n t r o` reads Intro if the body's words spell it in one way with the fewest words."""
    if not any(sum(len(x) == 1 and x.isalpha() for x in title.split(" ")) >= 3 for _, _, title in rows(segs)):
        return segs
    known = Counter(w for x, p in segs if not p for w in re.findall(r"[^\W\d_]{2,}", x.casefold()))
    for i, _, title in rows(segs):
        pieces = title.split(" ")
        single = [len(x) == 1 and x.isalpha() for x in pieces]
        if sum(single) < 3 or 2 * sum(single) < len(pieces):
            continue
        out, k = [], 0
        while k < len(pieces):
            j = k
            while j < len(pieces) and single[j]:
                j += 1
            word = fewest("".join(pieces[k:j]), known) if j - k >= 3 else None
            out += word if word else pieces[k : max(j, k + 1)]
            k = max(j, k + 1)
        segs[i] = [segs[i][0].replace(title, " ".join(out)), False]
    return segs


def fewest(letters: str, known: Counter) -> list[str] | None:
    """The split of letters into the fewest known words; None if there is none or more than one."""
    low, n = letters.casefold(), len(letters)
    best: list[tuple[int, int]] = [(0, 1)] + [(n + 1, 0)] * n  # words, ways
    back = [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(j):
            if best[i][1] and low[i:j] in known:
                k = best[i][0] + 1
                if k < best[j][0]:
                    best[j], back[j] = (k, best[i][1]), i
                elif k == best[j][0]:
                    best[j] = (k, best[j][1] + best[i][1])
    if best[n][1] != 1:
        return None
    out, j = [], n
    while j:
        out.append(letters[back[j] : j])
        j = back[j]
    return out[::-1]


# Printed contents


def contents_zones(segs: Segments) -> list[tuple[int, int]]:
    """[start, end) of what stands under a contents heading up to the next other heading."""
    heads = rows(segs)
    out = []
    for k, (i, _, title) in enumerate(heads):
        if fold(title) in CONTENTS:
            end = next((j for j, _, other in heads[k + 1 :] if fold(other) not in CONTENTS), len(segs))
            if not out or i >= out[-1][1]:
                out.append((i + 1, end))
    return out


def one_contents_heading(segs: Segments) -> Segments:
    """A contents heading that comes again before any other heading is a running one."""
    gone, before = set(), ""
    for i, _, title in rows(segs):
        key = fold(title)
        if key in CONTENTS and key == before:
            gone.add(i)
        before = key
    return [s for i, s in enumerate(segs) if i not in gone]


def records(segs: Segments) -> list[tuple[int, str]]:
    """(rank, folded title) of the printed contents: by dotted number, by rank word, else by the column or indent of the entry.

    A zone counts only if its ranks are a staircase: no rank is more than one below the one before it, and two are stated.
    """
    out: list[tuple[int, str]] = []
    for a, b in contents_zones(segs):
        zone: list[tuple[int, str]] = []
        words = {m[1].lower() for x, p in segs[a:b] if not p and (m := RANK.match(x.strip(" |")))}
        steps = sorted({len(x) - len(x.lstrip()) for x, p in segs[a:b] if not p and ENTRY.match(x)})
        for line, protected in segs[a:b]:
            if protected or not line.strip() or MARK.match(line):
                continue
            if ROW.match(line):
                cells = [c.strip() for c in line.strip().strip("|").split("|")]
                filled = [k for k, c in enumerate(cells) if c]
                if len(filled) < 2 or not re.fullmatch(r"\d+|[ivxlc]+", cells[filled[-1]], re.I):
                    continue
                text, column = " ".join(cells[k] for k in filled[:-1]), filled[0]
            elif m := ENTRY.match(line):
                text, column = m[1].strip(), steps.index(len(line) - len(line.lstrip()))
            else:
                continue
            text = re.sub(r"^[-*+]\s+", "", text)
            number = number_of(text)
            if (m := RANK.match(text)) and len(words) == 1:
                zone.append((1, fold(text[m.end() :] or text)))
            elif number:
                zone.append((len(number) + (1 if words else 0), fold(text)))
            else:
                zone.append((1 + column, fold(text)))
        ranks = sorted({r for r, _ in zone})
        dense = {r: k + 1 for k, r in enumerate(ranks)}
        zone = [(dense[r], t) for r, t in zone if t]
        if len(ranks) >= 2 and all(b[0] <= a[0] + 1 for a, b in zip(zone, zone[1:])) and zone[0][0] == 1:
            out += zone
    return out


def outlined(segs: Segments, stated: list[tuple[int, str]]) -> set[int]:
    """Headings named by the outline get its levels; if it names three or more, and half of all, the others hang below the last
    one named. The places of the headings it settles."""
    levels: dict[str, int] = {}
    for rank, title in stated:
        levels.setdefault(title, rank)
    heads = [r for r in rows(segs) if fold(r[2]) not in CONTENTS]
    hit = [(i, levels[fold(t)]) for i, _, t in heads if fold(t) in levels]
    if not hit:
        return set()
    for i, level in hit:
        relevel(segs, i, level)
    if len(hit) >= 3 and 2 * len(hit) >= len(heads):
        own, last = dict(hit), 0
        for i, _, title in heads:
            if i in own:
                last = own[i]
            elif last and len(title) <= 200 and not number_of(title):
                relevel(segs, i, last + 1)
    return {i for i, _ in hit}


# Headings that lost their signs


def standalone(segs: Segments, i: int) -> bool:
    blank = lambda k: k < 0 or k >= len(segs) or segs[k][1] or not segs[k][0].strip() or bool(MARK.match(segs[k][0]))
    return blank(i - 1) and blank(i + 1)


def lost(segs: Segments) -> Segments:
    """A numbered line of its own whose number stands between the headings of its depth around it, under a heading that is there."""
    heads = [(i, level, number_of(t)) for i, level, t in rows(segs) if number_of(t)]
    level_of: dict[int, Counter] = defaultdict(Counter)
    for _, level, n in heads:
        level_of[len(n)][level] += 1
    numbers = {n for _, _, n in heads}
    for i, (line, protected) in enumerate(segs):
        m = None if protected else SUB.match(line)
        if not m or len(line) > 200 or not re.search(r"[^\W\d_]", m[2]) or ENTRY.match(line) or re.search(r"[.;,]$", line.strip()) or not standalone(segs, i):
            continue
        n = tuple(int(x) for x in m[1].split("."))
        if n in numbers or n[:-1] not in numbers or not level_of[len(n)]:
            continue
        before = max((x for x in heads if x[0] < i and len(x[2]) == len(n)), default=None)
        after = min((x for x in heads if x[0] > i and len(x[2]) == len(n)), default=None)
        if (before or after) and (not before or before[2] < n) and (not after or n < after[2]):
            segs[i] = ["#" * min(level_of[len(n)], key=lambda v: (-level_of[len(n)][v], v)) + f" {line.strip()}", False]
    return segs


def unstyled(segs: Segments, ladder: int = 3, longest: int = 150) -> Segments:
    """A body without any heading: bold numbered paragraphs that follow each other, else three or more in capitals, are its headings."""
    if rows(segs) or any(not p and re.fullmatch(r"=+", x.strip()) for x, p in segs):
        return segs
    bold = [(i, m[2].strip()) for i, (x, p) in enumerate(segs) if not p and standalone(segs, i) and (m := re.fullmatch(r"\s*(\*\*|__)([^*_]+)\1\s*", x))]
    numbered = [(i, t, number_of(t)) for i, t in bold if number_of(t)]
    by: dict[tuple, list] = defaultdict(list)
    for i, t, n in numbered:
        by[n[:-1]].append((i, t, n))
    there = {n for _, _, n in numbered}
    proven = [x for parent, those in by.items() if len(those) >= ladder and [n[-1] for _, _, n in those] == list(range(those[0][2][-1], those[0][2][-1] + len(those))) and (not parent or len(parent) < 2 or parent in there) for x in those]
    if proven:
        chosen = {i for i, _, _ in proven} | {i for i, _, n in numbered if n[:-1] in there}
        for i, t, n in numbered:
            if i in chosen:
                segs[i] = ["#" * min(6, len(n)) + f" {t}", False]
        top = min(len(n) for _, _, n in proven)
        for i, t in bold:
            if i not in chosen and not number_of(t) and not t.endswith(":") and not t[:1].islower():
                segs[i] = ["#" * max(1, top - 1) + f" {t}", False]
        return segs
    caps = [(i, x.strip(" *_")) for i, (x, p) in enumerate(segs) if not p and standalone(segs, i) and len(x) <= longest and sum(c.isalpha() for c in x) >= 3 and x.upper() == x and not x.rstrip(" *").endswith(".") and not re.match(r"\s*(?:[-+|<>]|\d+[.)]\s)", x)]
    seen = Counter(t for _, t in caps)
    caps = [(i, t) for i, t in caps if seen[t] == 1]
    if len(caps) >= 3:
        last = -9
        for i, t in caps:
            if any(not segs[k][1] and segs[k][0].strip() for k in range(last + 1, i)) or last < 0:
                segs[i] = [f"## {t}", False]
                last = i
    return segs


# Levels


FORMS = (("(1)", re.compile(r"^\((\d+)\)\s")), ("1)", re.compile(r"^(\d+)[)、]\s?")), ("第", re.compile(r"^第([一二三四五六七八九十百\d]+)[章节節]")), ("一", re.compile(r"^([一二三四五六七八九十]+)、")))


def number_forms(segs: Segments) -> Segments:
    """Headings of one form of number are peers, one level below the heading that is open above their first one."""
    heads = rows(segs)
    form = {i: name for i, _, t in heads for name, rule in FORMS if rule.match(t)}
    kinds: dict[str, set] = defaultdict(set)
    for i, _, t in heads:
        if i in form:
            kinds[form[i]].add(dict(FORMS)[form[i]].match(t)[1])
    level_of: dict[str, int] = {}
    above = 0
    for i, level, _ in heads:
        name = form.get(i)
        if name and len(kinds[name]) >= 2:
            level_of.setdefault(name, above + 1 if above else level)
            relevel(segs, i, level_of[name])
        else:
            above = level
    return segs


def nested(segs: Segments, settled: set[int]) -> Segments:
    """An unnumbered heading hangs one below the numbered or stated section it stands in; sections beside all others end it."""
    stack: list[tuple[int, bool]] = []
    for i, level, title in rows(segs):
        fixed = bool(number_of(title)) or i in settled
        if fold(title).split(" ", 1)[0] in TOP and not number_of(title):
            stack = []
            continue
        while stack and (stack[-1][0] > level or stack[-1][0] == level and (fixed or not stack[-1][1])):
            stack.pop()
        if not fixed and stack and stack[-1][1]:
            level = min(6, stack[-1][0] + 1)
            relevel(segs, i, level)
        stack.append((level, fixed))
    return segs


def voted(segs: Segments, settled: set[int], copies: int = 3) -> Segments:
    """Copies of one unnumbered title stand on the level most of them have, the deeper one on a tie."""
    by: dict[str, list] = defaultdict(list)
    for i, level, title in rows(segs):
        if not number_of(title) and i not in settled:
            by[title].append((i, level))
    for those in by.values():
        if len(those) >= copies:
            have = Counter(level for _, level in those)
            level = max(have, key=lambda v: (have[v], v))
            for i, _ in those:
                relevel(segs, i, level)
    return segs


def gaps_closed(segs: Segments, settled: set[int]) -> Segments:
    """A section whose headings open two levels below their parent moves up by one, unless it holds a stated heading."""
    for _ in range(6):
        heads = rows(segs)
        moved = False
        for k, (_, level, _) in enumerate(heads):
            end = next((j for j in range(k + 1, len(heads)) if heads[j][1] <= level), len(heads))
            own = heads[k + 1 : end]
            if own and min(v for _, v, _ in own) == level + 2 and not any(i in settled for i, _, _ in own):
                for i, v, _ in own:
                    relevel(segs, i, v - 1)
                moved = True
                break
        if not moved:
            break
    return segs
