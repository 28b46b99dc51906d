"""Formulas in the lines of a body: where they stand, whether they are sound, loops in them, and the passes that mend them.

A formula is sound if it isn't empty and its braces, sizers and environments close in order. Passes take and give segments
([line, protected]); they change plain lines only, and a change that would make a sound formula unsound isn't made.
"""

from __future__ import annotations

import re

Segments = list[list]

CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
SPAN = re.compile(r"(?<!\\)\$\$(?!\$)(?P<display>.+?)(?<!\\)\$\$|(?<![\\$])\$(?!\s|\$)(?P<inline>[^$]*?[^\s$\\])\$(?!\$)")
TOKEN = re.compile(r"\\(begin|end)\s*\{([^{}]*)\}|\\(left|right)(?![A-Za-z])\s*(\\?.)?|\\[A-Za-z]+|\\.|[{}&]", re.S)
RULE = re.compile(r"^[|:\- \t]*-[|:\- \t]*$")
ROW = re.compile(r"^\s*\|.*\|\s*$")
#: Environments whose cells `&` sets apart, and signs of a single glyph (fixed values).
ALIGNED = frozenset("array matrix pmatrix bmatrix Bmatrix vmatrix Vmatrix smallmatrix aligned align align* alignedat cases rcases split eqnarray eqnarray* tabular subarray".split())
GLYPHS = {"\\varnothing": "∅", "\\emptyset": "∅", "\\circ": "°", "^\\circ": "°", "^{\\circ}": "°", "\\degree": "°", "\\pm": "±", "\\times": "×", "\\cdot": "·", "\\bullet": "•", "\\%": "%", "\\S": "§", "\\rightarrow": "→", "\\leftarrow": "←", "\\infty": "∞", "\\approx": "≈", "\\leq": "≤", "\\geq": "≥", "\\neq": "≠"}
SPACING = re.compile(r"(?:\\[,;:! ]|\\q?quad|\\hspace\*?\{[^{}]*\}|~|\s|\{\})*")
RELATION = re.compile(r"=|<|>|\\(?:leq?|geq?|neq?|approx|equiv|sim|propto|to|rightarrow|Rightarrow|in)\b")
CONTINUES = re.compile(r"^(?:[=+<>*/]|-(?!\d)|\\(?:times|cdot|pm|mp|leq?|geq?|neq?|approx|equiv|right|to|Rightarrow|rightarrow)\b)")
DANGLES = re.compile(r"(?:[=+<>*/-]|\\(?:times|cdot|pm|mp|leq?|geq?|neq?|approx|equiv|left\.?|to|Rightarrow|rightarrow))$")
NUMBER = re.compile(r"\s*\(\s*(\d+(?:\.\d+)*[a-z]?)\s*\)\s*$")


def code_masked(line: str) -> str:
    return CODE.sub(lambda m: " " * len(m.group()), line) if "`" in line else line


def spans(line: str) -> list[tuple[int, int]]:
    """[start, end) of the formulas of a line, with their signs; an open one that holds a command reaches to its end."""
    if "$" not in line:
        return []
    masked = code_masked(line)
    out = [m.span() for m in SPAN.finditer(masked)]
    last = out[-1][1] if out else 0
    tail = re.search(r"(?<![\\$])\$\$?(?=[^$]*\\[A-Za-z])[^$]*$", masked[last:])
    return out + [(last + tail.start(), len(line))] if tail else out


def inside(span: str) -> str:
    n = 2 if span.startswith("$$") else 1
    return span[n : len(span) - n if span.endswith("$" * n) and len(span) >= 2 * n else len(span)]


def unpaired(line: str) -> bool:
    """A dollar sign that opens or closes nothing stands outside of all formulas and code."""
    for a, b in reversed(spans(line)):
        line = line[:a] + " " * (b - a) + line[b:]
    return bool(re.search(r"(?<!\\)\$", code_masked(line)))


def on_spans(line: str, fix) -> str:
    """The line with fix(content, display) for the content of each closed formula; None takes a formula out."""
    out, at = [], 0
    for a, b in spans(line):
        span = line[a:b]
        signs = "$$" if span.startswith("$$") else "$"
        if not span.endswith(signs) or len(span) < 2 * len(signs) + 1:
            continue
        new = fix(inside(span), signs == "$$")
        out += [line[at:a], "" if new is None else signs + new + signs]
        at = b
    return "".join(out) + line[at:] if out else line


def scan(content: str) -> tuple[bool, list[tuple[int, int, str]], list[tuple[int, int, str]], list[int]]:
    """(braces and sizers close in order, open \\begin, orphan \\end, stray &)."""
    stack: list[tuple[str, int, int, str]] = []
    orphans, stray = [], []
    sound = True
    for m in TOKEN.finditer(content):
        t = m.group()
        if m[1] == "begin":
            stack.append(("env", m.start(), m.end(), m[2]))
        elif m[1] == "end":
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "env"), None)
            if k is not None and stack[k][3] == m[2]:
                sound &= k == len(stack) - 1
                del stack[k:]
            else:
                orphans.append((m.start(), m.end(), m[2]))
        elif m[3] == "left" or t == "{":
            stack.append(("left" if m[3] else "{", m.start(), m.end(), ""))
        elif m[3] == "right" or t == "}":
            if stack and stack[-1][0] == ("left" if m[3] else "{"):
                stack.pop()
            else:
                sound = False
        elif t == "&" and not any(k == "env" and name in ALIGNED for k, _, _, name in stack):
            stray.append(m.start())
    opened = [(a, b, name) for k, a, b, name in stack if k == "env"]
    return sound and len(opened) == len(stack), opened, orphans, stray


def is_sound(content: str) -> bool:
    if not content.strip():
        return False
    sound, opened, orphans, stray = scan(content)
    return sound and not opened and not orphans and not stray and not re.search(r"(?<!\\)(?:\\\\)*\\$", content.strip()) and not re.search(r"[_^]\s*$|[_^]{2}|\^\s*[_^]", content)


def open_environment(content: str) -> str:
    """The first environment that never closes; nothing if all do."""
    opened = scan(content)[1]
    return opened[0][2] if opened else ""


# Loops


def repeats(text: str, low: int, high: int, times: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of stretches in which a unit of low to high characters comes `times` in a row or more, the shortest
    unit first. Linear in the text for each period: a stretch is where a text agrees with itself moved by the period."""
    out: list[tuple[int, int, int]] = []
    n = len(text)
    for period in range(low, min(high, n // times) + 1):
        run = 0
        for i in range(period, n + 1):
            if i < n and text[i] == text[i - period]:
                run += 1
                continue
            if run >= period * (times - 1):
                a = i - run - period
                whole = a + (run // period + 1) * period
                if text[a : a + period].strip() and not any(x < whole and a < y for x, y, _ in out):
                    out.append((a, whole, period))
            run = 0
    return sorted(out)


#: A loop is sought exactly only where its first copies stand side by side.
LOOPED = {(3, 80, 6): re.compile(r"(.{3,80}?)\1{5}", re.S), (81, 400, 3): re.compile(r"(.{81,400}?)\1{2}", re.S)}


def looped(text: str, low: int, high: int, times: int) -> list[tuple[int, int, int]]:
    """As repeats, but with two necessary conditions first: a unit of p characters that comes `times` in a row leaves
    (times - 1) p - 7 stretches of eight characters or more that were there before, and has a back-reference that holds."""
    n = len(text) - 7
    if n - len({text[i : i + 8] for i in range(n)}) < (times - 1) * low - 7 or not LOOPED[low, high, times].search(text):
        return []
    return repeats(text, low, high, times)


def is_loop(span: str) -> bool:
    """A formula that fell into a loop: a short unit six times, a long one three times, or one column letter twenty times."""
    if len(span) < 18:
        return False
    return bool(looped(span, 3, 80, 6) or (len(span) >= 243 and any(b - a - p >= 400 for a, b, p in looped(span, 81, 400, 3))) or re.search(r"\{([lcr])\1{19,}", span))


def without_loops(line: str) -> str:
    """One copy of each loop: six repeats inside formulas, ten outside of them, of a unit with a letter and without `|`, `$` and code."""
    for _ in range(8):
        formulas = spans(line)
        cuts = []
        for a, b, period in looped(line, 3, 80, 6):
            unit = line[a : a + period]
            within = any(x < a and b < y for x, y in formulas)
            if within or b - a >= 10 * period and any(c.isalpha() for c in unit) and not set(unit) & set("|$`"):
                cuts.append((a + period, b))
        if not cuts:
            return line
        for a, b in reversed(cuts):
            line = line[:a] + line[b:]
    return line


def repeated_spans(line: str, least: int = 6, most_period: int = 8) -> list[tuple[int, int]]:
    """[start, end) to cut so that of inline formulas that come in cycles of up to `most_period` one cycle stays."""
    found = spans(line)
    texts = [line[a:b] for a, b in found]
    out, i = [], 0
    while i < len(texts):
        for p in range(1, most_period + 1):
            k = i + p
            while k < len(texts) and texts[k] == texts[k - p] and not line[found[k - 1][1] : found[k][0]].strip(" ,;"):
                k += 1
            if (k - i) // p >= least:
                out.append((found[i + p - 1][1], found[k - 1][1]))
                i = k - 1
                break
        i += 1
    return out


# Content of a formula


def fixed(content: str) -> str:
    """Commands as renderers know them, environments balanced, primes and double indices mended; left alone if that breaks it."""
    new = content
    _, _, orphans, stray = scan(new)
    for a, b, _ in reversed(orphans):
        head = new[:a]
        cut = [x for x in stray if x < a]
        for x in reversed(cut):
            head = head[:x] + head[x + 1 :]
        new = head + new[b:]
    _, opened, _, stray = scan(new)
    if opened and stray:
        a, b, _ = opened[0]
        rest = new[:a] + new[b:].replace("&", " ")
        new = rest if is_sound(rest) else new
    new = re.sub(r"\\eqno\s*\(\s*([^()]*?)\s*\)", r"\\tag{\1}", new)
    new = re.sub(r"\\(?:mbox|textsc)(?=\s*\{)", r"\\text", new)
    new = re.sub(r"\\label\s*\{[^{}]*\}", "", new)
    if '"' in new and "\\text" not in new:
        new = re.sub(r'(?<=\^\{)"(?=\})', r"\\prime\\prime", new)
        new = re.sub(r'(?<=[A-Za-z0-9})\]])"', "''", new)
    new = re.sub(r"(_\{[^{}]*\})(?=_\{)", r"\1{}", new)
    new = re.sub(r"(?<!\\)((?:\\\\)*)\\$", r"\1", re.sub(r"(?:\\\\\s*)+$", "", new.rstrip()))
    return content if is_sound(content) and not is_sound(new) else new


def without_orphan_sizers(content: str) -> str:
    """\\left or \\right with nothing to size goes."""
    return re.sub(r"\\(?:left|right)(?![A-Za-z])\s*(?=$|\s|[A-Za-z0-9{}])", "", content)


def with_partners(content: str) -> str:
    """A sizer without its partner gets an invisible one, if the formula is sound then."""
    if is_sound(content):
        return content
    lefts, rights = len(re.findall(r"\\left(?![A-Za-z])", content)), len(re.findall(r"\\right(?![A-Za-z])", content))
    new = content + " \\right." * max(0, lefts - rights) if lefts >= rights else "\\left. " * (rights - lefts) + content
    return new if is_sound(new) else content


# Passes


def each_span(segs: Segments, fix) -> Segments:
    return [[x if p or "$" not in x else on_spans(x, fix), p] for x, p in segs]


def reclosed(segs: Segments) -> Segments:
    """Inside of an open `$$`, backslashes glued to `$$` at a line's end close it."""
    opened = False
    out = []
    for line, protected in segs:
        if not protected and "$$" in line:
            if opened and re.search(r"\\+\$\$\s*$", line) and line.count("$$") == 1:
                line = re.sub(r"\s*\\+\$\$\s*$", "$$", line)
            if len(re.findall(r"(?<!\\)\$\$", line)) % 2:
                opened = not opened
        out.append([line, protected])
    return out


def table_math(segs: Segments) -> Segments:
    """Display formulas in rows of tables become inline ones, bare bars in them are escaped."""

    def fix(line: str) -> str:
        return re.sub(r"\$\$(.+?)\$\$", lambda m: "$" + re.sub(r"(?<!\\)\|", r"\\vert ", m[1].strip()) + "$", line)

    return [[fix(x) if not p and ROW.match(x) and "$$" in x else x, p] for x, p in segs]


def defused(segs: Segments) -> Segments:
    """A table in formula signs loses them."""
    return each_span_out(segs, lambda c: c.strip().startswith("\\begin{tabular}"))


def each_span_out(segs: Segments, false) -> Segments:
    out = []
    for line, protected in segs:
        if not protected and "$" in line:
            for a, b in reversed(spans(line)):
                if false(inside(line[a:b])):
                    line = line[:a] + inside(line[a:b]).strip() + line[b:]
        out.append([line, protected])
    return out


def without_html(content: str, _display: bool = False) -> str:
    new = re.sub(r"</?math[^<>]*>", "", re.sub(r"<sub>(.*?)</sub>", r"_{\1}", re.sub(r"<sup>(.*?)</sup>", r"^{\1}", content)))
    return new if new == content or is_sound(new) or not is_sound(content) else content


def lone_display(line: str) -> str | None:
    """Content of a display formula that has its line to itself."""
    core = line.strip()
    return core[2:-2].strip() if len(core) > 4 and core.startswith("$$") and core.endswith("$$") and core.count("$$") == 2 else None


def reunited(segs: Segments) -> Segments:
    """Display formulas one below the other that are one: the first isn't finished or the next one opens like a continuation."""
    out: Segments = []
    i = 0
    while i < len(segs):
        line, protected = segs[i]
        head = None if protected else lone_display(line)
        j = i + 1
        while head is not None:
            k = j
            while k < len(segs) and not segs[k][1] and not segs[k][0].strip():
                k += 1
            tail = lone_display(segs[k][0]) if k < len(segs) and not segs[k][1] else None
            if tail is None:
                break
            number = NUMBER.search(head)
            done = bool(number or "\\tag" in head or re.search(r"[.;]$", head))
            seam = re.search(r"\\right\.$", head) and re.match(r"\\left\.", tail)
            if not seam and not (CONTINUES.match(tail) and (not done or DANGLES.search(head))) and not DANGLES.search(head):
                break
            if seam:
                head, tail = re.sub(r"\s*\\right\.$", "", head), re.sub(r"^\\left\.\s*", "", tail)
            elif (a := DANGLES.search(head)) and (b := CONTINUES.match(tail)) and a.group().strip() == b.group().strip():
                tail = tail[b.end() :].strip()
            joined = f"{head} {tail}"
            if is_sound(head) and is_sound(tail) and not is_sound(joined):
                break
            head, j = joined, k + 1
        out.append([f"$${head}$$", False] if j > i + 1 else [line, protected])
        i = j
    return out


def prose_lifted(segs: Segments) -> Segments:
    """A legend in display signs goes back to the text: words in \\text, a formula and a dash, a third of it prose."""
    out = []
    for line, protected in segs:
        content = None if protected else lone_display(line)
        if content and "\\tag" not in content and "\\begin" not in content and "\\\\" not in content:
            prose = re.findall(r"\\text(?:rm|it)?\s*\{([^{}]*)\}", content)
            letters = sum(len(x) for x in prose)
            m = re.match(r"^(.+?)\s*(?:--?|—|–|\\text\{\s*[-—–])", content)
            if m and any(re.search(r"[^\W\d_]{3,}\s+[^\W\d_]{3,}", x) for x in prose) and letters >= 0.35 * len(content) and is_sound(m[1]) and len(m[1]) < 40:
                rest = re.sub(r"\\text(?:rm|it)?\s*\{([^{}]*)\}", r"\1", content[len(m[1]) :]).strip()
                line = f"${m[1].strip()}$ {rest}"
        out.append([line, protected])
    return out


def promoted(segs: Segments, least: int = 16) -> Segments:
    """A sound inline formula with a relation that is a paragraph by itself becomes a display formula."""
    blank = lambda k: k < 0 or k >= len(segs) or not segs[k][1] and (not segs[k][0].strip() or segs[k][0].startswith("<!--"))
    out = []
    for i, (line, protected) in enumerate(segs):
        core = line.strip()
        if not protected and re.fullmatch(r"\$[^$]+\$", core) and blank(i - 1) and blank(i + 1) and not line.startswith("    "):
            content = core[1:-1].strip()
            if len(content) >= least and RELATION.search(content) and is_sound(content):
                line = f"$${content}$$"
        out.append([line, protected])
    return out


def tagged(segs: Segments) -> Segments:
    """The number of a display formula, behind it or alone below it, becomes its tag; a lone sentence mark below it goes inside."""
    out: Segments = []
    i = 0
    while i < len(segs):
        line, protected = segs[i]
        content = None if protected else lone_display(line)
        if content is None:
            m = None if protected else re.fullmatch(r"\s*(\$\$[^$]+\$\$)\s*\((\d+(?:\.\d+)*[a-z]?)\)\s*", line)
            if m and "\\tag" not in m[1]:
                line = f"{m[1][:-2].rstrip()} \\tag{{{m[2]}}}$$"
            out.append([line, protected])
            i += 1
            continue
        if "\\tag" not in content and "\\begin" not in content:
            below = segs[i + 1][0].strip() if i + 1 < len(segs) and not segs[i + 1][1] else ""
            if m := NUMBER.search(content):
                if is_sound(content[: m.start()]):
                    line = f"$${content[: m.start()].rstrip()} \\tag{{{m[1]}}}$$"
            elif m := re.fullmatch(r"\((\d+(?:\.\d+)*[a-z]?)\)", below):
                line, i = f"$${content} \\tag{{{m[1]}}}$$", i + 1
            elif below in {".", ",", ";"}:
                line, i = f"$${content}{below}$$", i + 1
        out.append([line, protected])
        i += 1
    return out


def unwrapped(segs: Segments) -> Segments:
    """A formula of one sign is that sign; formulas of spaces alone go."""

    def fix(line: str) -> str:
        for a, b in reversed(spans(line)):
            content = inside(line[a:b]).strip()
            if content in GLYPHS:
                line = line[:a] + GLYPHS[content] + line[b:]
            elif line[a:b].endswith("$") and SPACING.fullmatch(content):
                line = line[:a] + (" " if line[a - 1 : a].isalnum() and line[b : b + 1].isalnum() else "") + line[b:]
        return line

    return [[fix(x) if not p and "$" in x else x, p] for x, p in segs]


def separated(segs: Segments) -> Segments:
    """A formula glued to the word or number before it gets a blank; amounts of money stay."""

    def fix(line: str) -> str:
        for a, b in reversed(spans(line)):
            content = inside(line[a:b])
            if line[a:b].endswith("$") and not re.match(r"[\d.,\s]*$", content) and not content[:1] in "^_":
                if line[b : b + 1].isalpha():
                    line = line[:b] + " " + line[b:]
                if line[a - 1 : a].isalnum():
                    line = line[:a] + " " + line[a:]
        return line

    return [[fix(x) if not p and "$" in x else x, p] for x, p in segs]


def tails_moved(segs: Segments) -> Segments:
    """Text behind a display formula that opens its line goes to a line of its own."""
    out: Segments = []
    for line, protected in segs:
        m = None if protected or ROW.match(line) else re.match(r"^(\s*\$\$[^$]+\$\$)\s+([^\W\d_].*)$", line)
        out += [[m[1], False], ["", False], [m[2], False]] if m and "$$" not in m[2] else [[line, protected]]
    return out


def stubs_cut(segs: Segments) -> Segments:
    """A formula with an environment that never closes keeps the head before it, if that is sound; else it goes."""

    def fix(content: str, display: bool) -> str | None:
        opened = scan(content)[1]
        if not opened:
            return content
        head = content[: opened[0][0]].rstrip()
        return head if is_sound(head) else None

    return each_span(segs, fix)


def mended(segs: Segments) -> Segments:
    """All passes over formulas, in their order."""
    segs = defused(table_math(reclosed(segs)))
    segs = reunited(segs)
    segs = each_span(segs, without_html)
    segs = each_span(segs, lambda c, _: fixed(c))
    segs = prose_lifted(segs)
    segs = tagged(promoted(segs))
    segs = unwrapped(segs)
    segs = each_span(segs, lambda c, _: with_partners(without_orphan_sizers(c) if not is_sound(c) else c))
    return tails_moved(separated(segs))
