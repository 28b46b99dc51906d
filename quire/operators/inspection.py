"""Edit lists of a language model, applied: addresses, placing of quotes, masks of sound formulas, guards, splicing.

One body and its edits meet in one row. Edits that quote a mask come last. An edit is placed on its addressed line or on the only
line within WINDOW that has its quote, judged by the whole line it would leave, and spliced in unless it meets an earlier one.
Every edit has one row in the outcome: `applied`, or why it isn't.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import formulas, grids
from quire.operators.kernels import rows
from quire.operators.zones import MARK, segments

WINDOW = 40
MASK = re.compile(r"⟦valid formula (\d+)⟧")
WORD = re.compile(r"[^\W\d_]+")
HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]")
IMAGE = re.compile(r"!\[[^\]\n]*\]\(([^()\s]*)\)")
KINDS = ("broken-formula", "broken-table", "broken-image", "flattened-block", "flattened-paragraphs", "run-in-heading", "letter-spacing", "hyphenation-gap")


def pages_of(lines: list[str]) -> dict[int, list[int]]:
    """Lines of each page, in order; those above the first mark are page 0."""
    out: dict[int, list[int]] = {0: []}
    page = 0
    for i, line in enumerate(lines):
        if m := MARK.match(line):
            page = int(m[1])
        out.setdefault(page, []).append(i)
    return out


def addresses(lines: list[str]) -> list[str]:
    """Every line behind its `page.line:`; lines count within their page from 1."""
    out = [""] * len(lines)
    for page, own in pages_of(lines).items():
        for k, i in enumerate(own):
            out[i] = f"{page}.{k + 1}: {lines[i]}"
    return out


def resolved(pages: dict[int, list[int]], page: int | None, line: int | None, n: int) -> int | None:
    """The line an address means: within its page, past its end the last line of the page; without pages, within the body."""
    if line is None or line < 1:
        return None
    if page is None or set(pages) == {0}:
        return min(line, n) - 1 if n else None
    own = pages.get(page)
    return own[min(line, len(own)) - 1] if own else None


def occurrences(line: str, quote: str) -> list[int]:
    out, at = [], line.find(quote)
    while at >= 0:
        out.append(at)
        at = line.find(quote, at + 1)
    return out


def placed(lines: list[str], at: int | None, old: str, new: str) -> tuple[int, int, int] | str:
    """(line, start, end) of a quote, or why it has no place."""
    if at is None:
        return "no address"

    def fragment(i: int) -> tuple[int, int, int] | None:
        hits = occurrences(lines[i], old)
        if len(hits) != 1:
            return None
        a = hits[0]
        # what would be put in must not stand there already
        if new.startswith(old) and lines[i][a:].startswith(new) or new.endswith(old) and lines[i][: a + len(old)].endswith(new) and new != old:
            return None
        return i, a, a + len(old)

    if lines[at] == old:
        return at, 0, len(old)
    if hit := fragment(at):
        return hit
    near = range(max(0, at - WINDOW), min(len(lines), at + WINDOW + 1))
    whole = [i for i in near if lines[i].strip() == old.strip()]
    if len(whole) == 1:
        return whole[0], 0, len(lines[whole[0]])
    if whole:
        return "several lines"
    parts = [hit for i in near if i != at and (hit := fragment(i))]
    if len(parts) == 1:
        return parts[0]
    return "several places" if parts or len(occurrences(lines[at], old)) > 1 else "no such text"


def masked(lines: list[str], protected: list[bool]) -> tuple[list[str], list[str]]:
    """Sound formulas as numbered masks, and what they stand for."""
    held: list[str] = []
    out = []
    for line, p in zip(lines, protected):
        for a, b in [] if p else reversed(formulas.spans(line)):
            if formulas.is_sound(formulas.inside(line[a:b])) and line[a:b].endswith("$"):
                held.append(line[a:b])
                line = f"{line[:a]}⟦valid formula {len(held)}⟧{line[b:]}"
        out.append(line)
    return out, held


def unmasked(text: str, held: list[str]) -> str | None:
    """The text with formulas for their masks; None if it names one that isn't there."""
    if any(not 1 <= int(m[1]) <= len(held) for m in MASK.finditer(text)):
        return None
    return MASK.sub(lambda m: held[int(m[1]) - 1], text)


def decoded(reply: str) -> list[dict]:
    """Edits of a reply: fences around the list, commas at ends and bare backslashes are forgiven; what can't be read gives none."""
    text = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", reply or "")
    text = text[text.find("[") : text.rfind("]") + 1]
    for fix in (lambda x: x, lambda x: re.sub(r",\s*([\]}])", r"\1", x), lambda x: re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", re.sub(r",\s*([\]}])", r"\1", x))):
        try:
            rows = json.loads(fix(text))
            return [r for r in rows if isinstance(r, dict) and isinstance(r.get("old"), str) and isinstance(r.get("new"), str)]
        except ValueError:
            continue
    return []


def units(lines: list[str], protected: list[bool]) -> dict[int, tuple[int, int]]:
    """Lines of a display formula cut over several lines share one address: line -> (first, last)."""
    out: dict[int, tuple[int, int]] = {}
    first = None
    for i, (line, p) in enumerate(zip(lines, protected)):
        if not p and line.count("$$") % 2:
            if first is None:
                first = i
            else:
                out.update((k, (first, i)) for k in range(first, i + 1))
                first = None
    return out


def realigned(lines: list[str], edits: list[dict], reach: int = 3) -> list[dict]:
    """Edits with all their lines moved by the one small step that confirms more quotes than their own numbers do."""
    pages = pages_of(lines)

    def confirmed(step: int) -> int:
        at = [(resolved(pages, e.get("page"), (e.get("line") or 0) + step, len(lines)), e.get("old") or "") for e in edits]
        return sum(i is not None and bool(old) and old in lines[i] for i, old in at)

    best = max(range(-reach, reach + 1), key=lambda s: (confirmed(s), -abs(s)))
    return [{**e, "line": e["line"] + best} if e.get("line") else e for e in edits] if confirmed(best) > confirmed(0) else edits


def values_kept(old: str, new: str) -> bool:
    """A row keeps its values, whatever cells they stand in."""
    flat = lambda x: Counter(" ".join(grids.cells(x)).split())
    return flat(old) == flat(new)


def accepted(body: str, touched: set[int]) -> tuple[str, list[int]]:
    """The body with the noise of edited lines taken off again, and edited rows that are off their table's grid."""
    from quire.operators.cleaning import NOISE

    segs = segments(body)
    lines = [NOISE.sub("", x).rstrip() if i in touched and not p else x for i, (x, p) in enumerate(segs)]
    off = grids.collapsed([[x, p] for x, (_, p) in zip(lines, segs)])
    return "\n".join(lines), sorted(i for i in touched if i in off)


# Guards


def math(line: str) -> list[str]:
    return [line[a:b] for a, b in formulas.spans(line)]


def outside(line: str) -> str:
    for a, b in reversed(formulas.spans(line)):
        line = line[:a] + " " + line[b:]
    return line


def digits(old: str, new: str, *_) -> bool:
    return re.findall(r"\d+", outside(old)) == re.findall(r"\d+", outside(new)) and not Counter(re.findall(r"\d+", " ".join(math(new)))) - Counter(re.findall(r"\d+", " ".join(math(old))))


def math_kept(old: str, new: str, *_) -> bool:
    a, b = math(old), math(new)
    return len(a) == len(b) and all(x == y or not formulas.is_sound(formulas.inside(x)) and formulas.is_sound(formulas.inside(y)) for x, y in zip(a, b)) if any(formulas.is_sound(formulas.inside(x)) for x in a) else True


def parity(old: str, new: str, *_) -> bool:
    return old.count("$") % 2 == new.count("$") % 2 or new.count("$") % 2 == 0


def images(old: str, new: str, *_) -> bool:
    return IMAGE.findall(old) == IMAGE.findall(new)


def row_shape(old: str, new: str, *_) -> bool:
    return not grids.ROW.match(old) or bool(grids.ROW.match(new)) and len(grids.cells(old)) == len(grids.cells(new))


def grid(old: str, new: str, *_) -> bool:
    return bool(grids.RULE.match(old) and "|" in old) == bool(grids.RULE.match(new) and "|" in new)


def cells_apart(old: str, new: str, *_) -> bool:
    if not grids.ROW.match(old) or not grids.ROW.match(new):
        return True
    a, b = grids.cells(old), grids.cells(new)
    return all(not (b[i] == b[j] != "" and a[i] != a[j]) for i in range(len(b)) for j in range(i)) if len(a) == len(b) else False


def no_split(old: str, new: str, words: Counter) -> bool:
    """A blank inside of what was one word needs both halves in the body or its source."""
    had = {w.casefold() for w in WORD.findall(old)}
    now = {w.casefold() for w in WORD.findall(new)}
    pairs = [(a.casefold(), b.casefold()) for a, b in re.findall(r"([^\W\d_]+)\s+(?=([^\W\d_]+))", new)]
    return all(a + b not in had or a + b in now or words[a] > 0 and words[b] > 0 for a, b in pairs)


def no_break(old: str, new: str, words: Counter) -> bool:
    """A hyphen inside of what was one word needs the hyphened word in the body or its source."""
    had = {w.casefold() for w in WORD.findall(old)}
    return all((a + b).casefold() not in had or words[f"{a}-{b}".casefold()] > 0 for a, b in re.findall(r"([^\W\d_]+)-([^\W\d_]+)", new))


def heading(old: str, new: str, *_) -> bool:
    a, b = HEAD.match(old), HEAD.match(new)
    return (a and a[1]) == (b and b[1])


def markup(old: str, new: str, *_) -> bool:
    tags = lambda x: Counter(t.lower() for t in re.findall(r"</?su[bp]>", x, re.I))
    return tags(old) == tags(new) and (old.count("**") % 2 == 1 or new.count("**") % 2 == 0)


def letter_emphasis(old: str, new: str, *_) -> bool:
    one = lambda x: re.findall(r"(?<!\*)\*{1,2}[^\W\d_]\*{1,2}(?!\*)", x)
    return len(one(new)) <= len(one(old))


def end_hyphen(old: str, new: str, *_) -> bool:
    return not re.search(r"[^\W\d_]-\s*$", old) or bool(re.search(r"-\s*$", new))


def commands(old: str, new: str, *_) -> bool:
    return not set(re.findall(r"\\[A-Za-z]+", outside(new))) - set(re.findall(r"\\[A-Za-z]+", old))


def escapes(old: str, new: str, *_) -> bool:
    return not re.search(r"\\[nt](?![A-Za-z])", new) or bool(re.search(r"\\[nt](?![A-Za-z])", old))


def protocol(old: str, new: str, *_) -> bool:
    return not re.search(r'"(?:old|new|page|line)"\s*:', new) or bool(re.search(r'"(?:old|new|page|line)"\s*:', old))


def defect_names(old: str, new: str, *_) -> bool:
    return not any(k in new and k not in old for k in KINDS)


def display_shape(old: str, new: str, *_) -> bool:
    return (formulas.lone_display(old) is None) == (formulas.lone_display(new) is None)


def no_duplicate(old: str, new: str, *_) -> bool:
    extra = Counter(math(new)) - Counter(math(old))
    return not any(x in math(old) for x in extra)


#: Why an edit is refused and the rule it breaks; the first one speaks.
GUARDS = [
    ("digits changed", digits), ("formula changed", math_kept), ("formula signs changed", parity), ("image changed", images), ("row shape changed", row_shape), ("grid changed", grid), ("cells made equal", cells_apart),
    ("heading mark changed", heading), ("inline markup changed", markup), ("letter emphasised", letter_emphasis), ("line break hyphen lost", end_hyphen), ("literal escape", escapes), ("new command", commands), ("reply syntax", protocol),
    ("defect name", defect_names), ("display line changed", display_shape), ("formula doubled", no_duplicate), ("word split", no_split), ("word broken", no_break),
]


def rejection(old: str, new: str, words: Counter) -> str | None:
    """The first guard that the change of a line breaks; words: words and hyphened words of the body and its source."""
    return next((name for name, keeps in GUARDS if not keeps(old, new, words)), None)


def witness(*texts: str) -> Counter:
    out: Counter = Counter()
    for text in texts:
        out.update(w.casefold() for w in WORD.findall(text or ""))
        out.update(w.casefold() for w in re.findall(r"[^\W\d_]+-[^\W\d_]+", text or ""))
    return out


def applied(body: str, edits: list[dict], source: str = "") -> tuple[str, list[tuple[int, int | None, str]]]:
    """The edited body, and (place in the list, line, outcome) of each edit (page, line, old, new)."""
    segs = segments(body)
    lines = [s[0] for s in segs]
    pages, words = pages_of(lines), witness(body, source)
    shown, held = masked(lines, [s[1] for s in segs])
    new_lines = list(lines)
    taken: dict[int, list[tuple[int, int, str]]] = {}
    out: list[tuple[int, int | None, str]] = []
    for k, e in sorted(enumerate(edits), key=lambda x: (bool(MASK.search(x[1].get("old") or "")), x[0])):
        old, new = e.get("old"), e.get("new")
        if not old or new is None:
            out.append((k, None, "no text"))
            continue
        if old == new:
            out.append((k, None, "no change"))
            continue
        at = resolved(pages, e.get("page"), e.get("line"), len(lines))
        if MASK.search(old):
            spot = placed(shown, at, old, new)
            if not isinstance(spot, str):  # the masks of the line read as what they stand for
                plain, new = unmasked(old, held), unmasked(new, held)
                spot = "unknown mask" if plain is None or new is None else placed(lines, spot[0], plain, new)
        else:
            spot = placed(lines, at, old, new)
        if isinstance(spot, str):
            out.append((k, None, spot))
            continue
        i, a, b = spot
        if segs[i][1]:
            out.append((k, i, "protected"))
            continue
        if any(x < b and a < y or (a, b) == (x, y) for x, y, _ in taken.get(i, ())):
            out.append((k, i, "conflict"))
            continue
        parts = sorted([*taken.get(i, []), (a, b, new)])
        line, last = [], 0
        for x, y, text in parts:
            line += [lines[i][last:x], text]
            last = y
        whole = "".join(line) + lines[i][last:]
        if m := re.match(r"^(\$\$[^$]*)\$\$([.,;])$", whole.strip()):
            whole = f"{m[1]}{m[2]}$$"  # a mark behind a display formula goes inside
        reason = next((r for piece in [whole] if (r := rejection(lines[i], piece.split("\n")[0] if "\n" not in new else piece.replace("\n", " "), words))), None)
        if reason:
            out.append((k, i, reason))
            continue
        taken.setdefault(i, []).append((a, b, new))
        new_lines[i] = whole
        out.append((k, i, "applied"))
    return "\n".join(new_lines), sorted(out)


def edited(bodies: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(result_id, body) after its edits, and (reply_id, line_no, outcome) of each; edits: reply_id, result_id, page, line,
    old_text, new_text. Edits of results without a body have the outcome `no body`. A result's edits are as many as its replies."""
    lists = edits.where("result_id is not null").groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("reply_id", "page", "line", F.col("old_text").alias("old"), F.col("new_text").alias("new")))).alias("edits"))
    both = bodies.select("result_id", "body").join(lists, "result_id", "right")

    def outcome(result, body, edits):
        if body is None:
            for e in edits:
                yield e["reply_id"], None, "no body"
            return
        for k, line, what in applied(body, edits)[1]:
            yield edits[k]["reply_id"], line, what

    def text(result, body, edits):
        if body is not None:
            yield result, applied(body, edits)[0]

    both = both.select("result_id", "body", "edits")
    return rows(both, text, "result_id bigint, body string"), rows(both, outcome, "reply_id bigint, line_no int, outcome string")


def numbered(bodies: DataFrame) -> DataFrame:
    """(result_id, line_no, address): every line behind its address, as a model is shown it."""

    def run(result: int, body: str) -> Iterator[tuple]:
        for i, x in enumerate(addresses(body.split("\n"))):
            yield result, i, x

    return rows(bodies.where("body is not null").select("result_id", "body"), run, "result_id bigint, line_no int, address string")
