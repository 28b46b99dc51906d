"""Lists of a body: demoted numbers, loose series, items lifted to their series, a lone child, stray bullets."""

from __future__ import annotations

import re

Segments = list[list]

ITEM = re.compile(r"^(\s*)([-*+]|\(?(?:\d{1,4}|[A-Za-zА-Яа-я])[.)])([ \t]+)(\S.*)$")
NUMBER = re.compile(r"^(\d{1,4})([.)])\s+(\S.*)$")
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшщэюя"


def value(marker: str) -> tuple[str, int] | None:
    """(scheme, place) of a marker: digits, Latin or Cyrillic letters, each with its brackets."""
    m = re.fullmatch(r"(\(?)(\d+|[A-Za-zА-Яа-я])([.)])", marker)
    if not m:
        return None
    core, kind = m[2], m[1] + m[3]
    if core.isdigit():
        return "9" + kind, int(core)
    for name, letters in (("a", LATIN), ("а", CYRILLIC)):
        if core.lower() in letters:
            return (name if core.islower() else name.upper()) + kind, letters.index(core.lower()) + 1
    return None


def lifted(items: list[list]) -> bool:
    """Items that carry on the series of the item before them stand where it stands; items: [indent, marker, text]."""
    changed = False
    for k in range(1, len(items)):
        a, b = value(items[k - 1][1]), value(items[k][1])
        if a and b and a[0] == b[0] and b[1] == a[1] + 1 and items[k][0] > items[k - 1][0] and not (items[k - 1][1].strip("().").lower() == "h" and items[k][1].strip("().").lower() == "i"):
            shift, own = items[k][0] - items[k - 1][0], items[k][0]
            j = k
            while j < len(items) and (j == k or items[j][0] > own):
                items[j][0] -= shift
                j += 1
            changed = True
    return changed


def renumbered(items: list[list]) -> bool:
    """Bullets whose texts are numbered one after the other are the numbered list they were; what hangs on them moves along."""
    base = min(i[0] for i in items)
    numbers = [(k, m) for k, i in enumerate(items) if i[1] in "-*+" and i[0] == base and (m := NUMBER.match(i[2]))]
    plain = [k for k, i in enumerate(items) if i[0] == base]
    values = [int(m[1]) for _, m in numbers]
    if len(numbers) < 2 or len(numbers) != len(plain) or values != list(range(values[0], values[0] + len(values))):
        return False
    for k, m in numbers:
        shift = len(m[1])
        items[k][1], items[k][2] = m[1] + m[2], m[3]
        j = k + 1
        while j < len(items) and items[j][0] > base:
            items[j][0] += shift
            j += 1
    return True


def block(lines: list[str], followed: bool) -> list[str]:
    """The lines of one list, mended; followed: indented text comes after it, so its indents stay."""
    rows = [ITEM.match(x) for x in lines]
    items = [[len(m[1].expandtabs(4)), m[2], m[4]] for m in rows]
    if len(items) < 2 or items[0][0] > 3 or followed:
        return lines
    changed = lifted(items)
    if not renumbered(items):
        base = items[0][0]
        deeper = [k for k, i in enumerate(items) if i[0] > base]
        if len(deeper) == 1 and deeper[0] >= 2 and all(i[1] in "-*+" and not NUMBER.match(i[2]) for i in items):
            items[deeper[0]][0] = base
            changed = True
        elif not changed:
            return lines
    return [" " * max(0, i[0]) + f"{i[1]} {i[2]}" for i in items]


def normalized(segs: Segments) -> Segments:
    out: Segments = []
    i = 0
    while i < len(segs):
        j = i
        while j < len(segs) and not segs[j][1] and ITEM.match(segs[j][0]):
            j += 1
        if j == i:
            out.append(segs[i])
            i += 1
            continue
        k = j
        while k < len(segs) and not segs[k][1] and not segs[k][0].strip():
            k += 1
        followed = k > j and k < len(segs) and bool(re.match(r"\s{2,}\S", segs[k][0])) and not ITEM.match(segs[k][0])
        out += [[x, False] for x in block([s[0] for s in segs[i:j]], followed)]
        i = j
    return loose_series(out)


def loose_series(segs: Segments) -> Segments:
    """`- 1.` bullets set apart by blanks alone, one number after the other, are a loose numbered list."""
    rows = [(k, m[1], n) for k, (x, p) in enumerate(segs) if not p and (m := ITEM.match(x)) and m[2] in "-*+" and (n := NUMBER.match(m[4]))]
    series: list[list] = []
    for k, indent, n in rows:
        if series and series[-1][-1][1] == indent and int(n[1]) == int(series[-1][-1][2][1]) + 1 and n[2] == series[-1][-1][2][2] and all(not segs[x][1] and not segs[x][0].strip() for x in range(series[-1][-1][0] + 1, k)):
            series[-1].append((k, indent, n))
        else:
            series.append([(k, indent, n)])
    for s in series:
        if len(s) >= 2:
            for k, indent, n in s:
                segs[k] = [f"{indent}{n[1]}{n[2]} {n[3]}", False]
    return segs


def without_stray_bullets(segs: Segments) -> Segments:
    """A bullet at a line's end, or alone on it, goes."""
    out = []
    for line, protected in segs:
        if not protected and re.search(r"[❚▌■▪●]\s*$", line):
            line = re.sub(r"\s*[❚▌■▪●]+\s*$", "", line)
            if not line.strip():
                continue
        out.append([line, protected])
    return out
