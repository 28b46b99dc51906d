"""Pipe tables inside the cleaning chain: rows cut apart and put together again, values back under their columns, lines laid out.

A table is a header row with a rule below it and rows up to a line without a bar. Passes take and give segments; a change that
can't be told for sure isn't made.
"""

from __future__ import annotations

import re
from collections import Counter

Segments = list[list]

ROW = re.compile(r"^\s*\|.*\|\s*$")
RULE = re.compile(r"^[|:\- \t]*-[|:\- \t]*$")
BREAK = re.compile(r"\s*<br\s*/?>\s*", re.I)
NUMERIC = re.compile(r"[-–+±]?\d[\d.,]*%?$")
ENTRY = re.compile(r"^(?P<number>\d+(?:\.\d+)*\.?)?\s*(?P<title>\S.*?)\s*(?:[.…·]{2,}|(?:\s\.){2,}|\s)\s*(?P<page>\d+)$")
LIST = re.compile(r"^\s*(?:[-*+]|\d{1,9}[.)])\s")


def cells(line: str) -> list[str]:
    core = re.sub(r"\|\s*$", "", re.sub(r"^\s*\|", "", line))
    return [c.strip() for c in re.split(r"(?<!\\)\|", core)]


def row(values: list[str]) -> str:
    return "| " + " | ".join(values) + " |"


def form(value: str) -> str:
    return re.sub(r"[^\W\d_]+", "A", re.sub(r"\d+", "9", value.strip()))


def grouped(pieces: list[str]) -> bool:
    """`17 440` and `1 250 000` are one number."""
    return len(pieces) > 1 and bool(re.fullmatch(r"\d{1,3}", pieces[0])) and all(re.fullmatch(r"\d{3}(?:[.,]\d+)?", p) for p in pieces[1:])


def numbers_in(cell: str) -> list[str]:
    """Two or more numbers crushed into one cell; nothing if it holds anything else or one grouped number."""
    pieces = cell.split()
    return pieces if len(pieces) > 1 and all(NUMERIC.fullmatch(p) for p in pieces) and not grouped(pieces) else []


def folded(head: list[str], body: list[list[str]]) -> tuple[list[str], list[list[str]]] | None:
    """`No.,Size,No.,Size` as `No.,Size`: the groups of columns one below the other."""
    n = len(head)
    if any(len(r) != n for r in body):
        return None
    for p in range(2, n // 2 + 1):
        if n % p == 0 and head == head[:p] * (n // p) and any(head[:p]) and not any(NUMERIC.fullmatch(h) for h in head[:p]):
            out = [r[k : k + p] for k in range(0, n, p) for r in body]
            while out and not any(out[-1]):
                out.pop()
            return head[:p], out
    return None


def contents(head: list[str], body: list[list[str]], least: int = 3, share: float = 0.6) -> list[str] | None:
    """A table of one column that is a printed contents, as lines without leaders."""
    if len(head) != 1 or any(len(r) != 1 for r in body):
        return None
    pieces = [p for r in [head, *body] for p in BREAK.split(r[0]) if p]
    hits = [ENTRY.match(p) for p in pieces]
    if len(pieces) < least or not hits[0] or sum(map(bool, hits)) < share * len(pieces) or not any(m and m["number"] and "." in m["number"].rstrip(".") for m in hits):
        return None
    return [" ".join(x for x in (m["number"], m["title"].rstrip(" .…·"), m["page"]) if x) if m else p for p, m in zip(pieces, hits)]


def periodic(head: list[str], body: list[list[str]], least: int = 4) -> tuple[list[str], list[list[str]]] | None:
    """A table crushed into its header: one stacked cell of values beside named titles, cut by their number if every column keeps one form."""
    if any(any(r) for r in body):
        return None
    stacked = [k for k, h in enumerate(head) if BREAK.search(h)]
    titles = [h for k, h in enumerate(head) if k not in stacked and h]
    n = len(titles)
    if len(stacked) != 1 or n < 2:
        return None
    values = [v for v in BREAK.split(head[stacked[0]]) if v]
    if len(values) % n or len(values) // n < least:
        return None
    out = [values[k : k + n] for k in range(0, len(values), n)]
    return (titles, out) if all(len({form(r[k]) for r in out}) == 1 for k in range(n)) else None


def continued(head: list[str], body: list[list[str]], narrow: int = 8) -> list[list[str]]:
    """Rows that only carry on the wrapped text of the row above join it."""
    width = [max((len(p) for r in body if k < len(r) for p in BREAK.split(r[k])), default=0) for k in range(len(head))]
    out: list[list[str]] = []
    for r in body:
        above = out[-1] if out else None
        filled = [k for k, c in enumerate(r) if c]
        if (
            above and filled and len(r) == len(above) == len(head) and not r[0] and above[0]
            and all(above[k] and not NUMERIC.fullmatch(above[k]) and r[k][0].islower() and not LIST.match(r[k]) and width[k] >= narrow and len(BREAK.split(above[k])[-1]) + 1 + len(r[k].split()[0]) > width[k] for k in filled)
        ):
            out[-1] = [f"{a} {b}" if b else a for a, b in zip(above, r)]
        else:
            out.append(r)
    return out


def recut(head: list[str], body: list[list[str]]) -> list[list[str]]:
    """Numbers crushed into one cell go back to the empty cells beside it, if these are just as many and their columns have values."""
    n = len(head)
    if any(len(r) != n for r in body):
        return body
    for _ in range(4):
        attested = [any(NUMERIC.fullmatch(r[k]) for r in body) or bool(head[k]) and not any(r[k] for r in body) for k in range(n)]
        changed = False
        for i, r in enumerate(body):
            for k in range(n):
                values = numbers_in(r[k])
                if not values:
                    continue
                a, b = k, k + 1
                while a > 0 and not r[a - 1]:
                    a -= 1
                while b < n and not r[b]:
                    b += 1
                if b - a == len(values) and all(attested[j] for j in range(a, b) if j != k):
                    body[i] = r = r[:a] + values + r[b:]
                    changed = True
        if not changed:
            break
    return body


def spread(head: list[str], body: list[list[str]]) -> list[list[str]]:
    """A crushed run beside more empty cells than it needs goes where the forms of the columns leave it one place."""
    n = len(head)
    forms: list[set] = [{form(r[k]) for r in body if len(r) == n and r[k] and not numbers_in(r[k])} for k in range(n)]
    for i, r in enumerate(body):
        if len(r) != n:
            continue
        for k in range(n):
            values = numbers_in(r[k])
            a, b = k, k + 1
            while a > 0 and not r[a - 1]:
                a -= 1
            while b < n and not r[b]:
                b += 1
            if values and b - a > len(values):
                fits = [s for s in range(max(a, k - len(values) + 1), min(k, b - len(values)) + 1) if all(form(v) in forms[s + j] for j, v in enumerate(values))]
                if len(fits) == 1:
                    s = fits[0]
                    body[i] = r = r[:a] + [""] * (s - a) + values + [""] * (b - s - len(values)) + r[b:]
    return body


def blocks(segs: Segments) -> list[tuple[int, int]]:
    """[start, end) of runs of rows."""
    out, i = [], 0
    while i < len(segs):
        j = i
        while j < len(segs) and not segs[j][1] and ROW.match(segs[j][0]):
            j += 1
        if j > i:
            out.append((i, j))
        i = max(j, i + 1)
    return out


def repaired(segs: Segments) -> Segments:
    """All passes over the tables of a body."""
    out: Segments = []
    at = 0
    for a, b in blocks(segs):
        out += segs[at:a]
        at = b
        lines = [s[0] for s in segs[a:b]]
        if len(lines) > 2 and RULE.match(lines[0]) and not RULE.match(lines[1]):
            lines[0], lines[1] = lines[1], lines[0]  # a rule above its header
        if len(lines) >= 2 and not any(RULE.match(x) for x in lines) and len({len(cells(x)) for x in lines}) == 1 and len(cells(lines[0])) >= 2 and not any(LIST.match(x.strip().strip("|")) for x in lines):
            lines.insert(1, "|" + " --- |" * len(cells(lines[0])))
        if len(lines) < 2 or not RULE.match(lines[1]):
            out += [[x, False] for x in lines]
            continue
        head, body = cells(lines[0]), [cells(x) for x in lines[2:]]
        if (plain := contents(head, body)) is not None:
            out += [[x, False] for x in plain]
            continue
        new = folded(head, body) or periodic(head, body)
        if new:
            head, body = new
            rule = ["---"] * len(head)
        else:
            rule = cells(lines[1])
            body = spread(head, recut(head, continued(head, body)))
        out += [[row(head), False], [row(rule), False], *[[row(r), False] for r in body]]
    return out + segs[at:]


def glued_headers(segs: Segments) -> Segments:
    """Prose glued before a header row goes to a line of its own: `Some text: | a | b |` above a rule of two columns."""
    out: Segments = []
    for i, (line, protected) in enumerate(segs):
        below = segs[i + 1][0] if i + 1 < len(segs) and not segs[i + 1][1] else ""
        if not protected and not line.lstrip().startswith("|") and line.rstrip().endswith("|") and RULE.match(below) and "|" in below:
            head, _, rest = line.partition("|")
            if len(head.split()) >= 3 and len(cells("|" + rest)) == len(cells(below)):
                out += [[head.rstrip(), False], ["", False], ["|" + rest, False]]
                continue
        out.append([line, protected])
    return out


def entries_whole(segs: Segments) -> Segments:
    """In rows that end in a page number a break inside of the title is a blank; an entry without one goes on in the row below."""
    out: Segments = []
    for line, protected in segs:
        if not protected and ROW.match(line) and re.search(r"\|\s*\d{1,4}\s*\|\s*$", line):
            line = BREAK.sub(" ", line)
            head = cells(line)
            if out and not out[-1][1] and ROW.match(out[-1][0]) and not RULE.match(out[-1][0]):
                above = cells(out[-1][0])
                if len(above) == len(head) >= 2 and above[0] and not above[-1] and not head[0] and head[1][:1].islower() and len(head) > 2:
                    out[-1] = [row([f"{a} {b}".strip() for a, b in zip(above, head)]), False]
                    continue
        out.append([line, protected])
    return out


def math_cells_open(segs: Segments) -> Segments:
    """A formula alone in a cell of an HTML table stands on a line of its own, with blank lines around it, so that it is rendered."""
    return [[re.sub(r"(<t[dh][^<>]*>)\s*(\$\$[^$]+\$\$)\s*(</t[dh]>)", r"\1\n\n\2\n\n\3", x) if p and "<t" in x and "$$" in x else x, p] for x, p in segs]


def laid_out(segs: Segments, ceiling: int = 120) -> Segments:
    """Columns of equal width where the table isn't wider than the ceiling, else one blank on each side."""
    for a, b in blocks(segs):
        rows = [cells(s[0]) for s in segs[a:b]]
        if b - a < 2 or not RULE.match(segs[a + 1][0]) or len({len(r) for r in rows}) != 1:
            continue
        width = [max(3, *(len(r[k]) for i, r in enumerate(rows) if i != 1)) for k in range(len(rows[0]))]
        wide = sum(width) + 3 * len(width) + 1 <= ceiling
        for i, r in enumerate(rows):
            if i == 1:
                dashes = [(":" if c.startswith(":") else "") + "-" * ((w if wide else 3) - c.startswith(":") - c.endswith(":")) + (":" if c.endswith(":") else "") for c, w in zip(r, width)]
                segs[a + i] = [row(dashes), False]
            else:
                segs[a + i] = [row([c.ljust(w) if wide else c for c, w in zip(r, width)]), False]
    return segs


def collapsed(segs: Segments) -> dict[int, str]:
    """Lines of tables without a header or with values crushed into one cell beside as many empty ones: line -> what is wrong."""
    out: dict[int, str] = {}
    for a, b in blocks(segs):
        if b - a < 2 or not RULE.match(segs[a + 1][0]):
            continue
        head = cells(segs[a][0])
        if not any(head) and b - a > 2:
            out[a] = "header=missing"
        width = len(cells(segs[a + 1][0]))
        widths = Counter(len(cells(segs[i][0])) for i in range(a, b) if i != a + 1)
        for i in range(a, b):
            r = cells(segs[i][0])
            if i != a + 1 and widths[width] and len(r) != width:
                out[i] = f"expected={width} got={len(r)}"
            elif i > a + 1 and any(len(numbers_in(c)) > 1 and sum(not x for x in r) >= len(numbers_in(c)) - 1 for c in r):
                out.setdefault(i, f"collapsed={sum(len(numbers_in(c)) for c in r)}")
    return out
