"""Problem 3: markup residue, found by minimum cut and turned into clean Markdown.

The field's own markup, code, formulas and page marks are set aside. Every mark that could belong to a foreign markup
becomes a node; a classifier's costs (kind of mark, known name, readable surroundings, path) are its capacities to the
terminals. Weak marks (an unknown tag or command, a lone list line or row) speak for content by themselves; smoothness edges
tie them to the marks near them, to those in the same element or paragraph and to their partners, so they follow what
surrounds them. Max-flow separates residue from content. Cleaning rewrites the marks the cut chose and nothing else.

Null and empty texts give no row, junk without readable surroundings none. Repeated deliveries of a record give one row.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import deque
from math import exp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common as C

SCHEMA = "field_name string, rec_id bigint, markup string, n_marks int"
CLEAN = "field_name string, rec_id bigint, markups array<string>, clean string"

TAGS = "a|abbr|b|big|blockquote|br|caption|center|cite|code|dd|del|div|dl|dt|em|figcaption|figure|font|h[1-9]|hr|i|img|ins|kbd|li|mark|ol|p|pre|q|s|section|small|span|strike|strong|sub|sup|table|tbody|td|tfoot|th|thead|tr|tt|u|ul|var|nobr|html|body|head|title|script|style|iframe|input|form|button|label|col|colgroup"
COMMANDS = (
    "textbf|textit|textsl|textrm|textsf|textsc|texttt|textsuperscript|textsubscript|emph|underline|section|subsection|subsubsection|chapter|part|paragraph|subparagraph|begin|end|item|footnote|footnotemark|"
    "cite|citep|citet|ref|eqref|pageref|label|caption|noindent|indent|hfill|vfill|hspace|vspace|hline|newline|linebreak|newpage|clearpage|pagebreak|url|href|includegraphics|centering|"
    "tableofcontents|title|author|date|maketitle|it|bf|tt|em|rm|sc|small|large|Large|par|bigskip|medskip|smallskip|quad|qquad|enquote|index|input|include|usepackage|documentclass|today|ldots|dots|LaTeX|TeX|multicolumn"
)
#: kind, pattern, weight of the mark by itself
MARKS: dict[str, list[tuple[re.Pattern, float]]] = {
    "html": [
        (re.compile(rf"</?(?:{TAGS})(?:\s[^<>\n]*|\n[^<>\n]*)?/?>", re.I), 2.5),
        (re.compile(rf"&(?:amp;)*lt;/?(?:{TAGS})\b(?:(?!&(?:amp;)*[lg]t;)[^<>\n])*&(?:amp;)*gt;", re.I), 2.5),
        (re.compile(r"&(?:amp;)*(?:nbsp|amp|lt|gt|quot|apos|shy|ndash|mdash|hellip|laquo|raquo|ldquo|rdquo|[aeiouAEIOU](?:uml|acute|grave|circ)|szlig|ccedil|#\d{2,5}|#x[0-9a-fA-F]{2,5});"), 1.5),
        (re.compile(r"<!--(?! ?source:page)[^-]*(?:-(?!->)[^-]*)*-->|<!DOCTYPE[^<>]*>", re.S), 2.0),
    ],
    "wiki": [
        (re.compile(r"(?<!')('{2,3}|'{5})(?![\s'])(?:(?!''|\n[ \t]*\n[ \t]*\n).)+(?<!\s)\1(?!')", re.S), 2.0),
        (re.compile(r"^[ \t]*(={2,6})[ \t]*[^=\n]*[^\W\d_]{2}[^=\n]*?\1[ \t]*$", re.M), 2.5),
        (re.compile(r"\[\[[^\[\]]+\]\]"), 2.0),
        (re.compile(r"\{\{[^\W\d_][^{}]*\}\}"), 2.0),
        (re.compile(r"^[ \t]*(?:\{\|.*|\|-+[^|\n]*|\|\+.*|\|\})[ \t]*$", re.M), 1.5),
        (re.compile(r"^[ \t]*[|!][^|\n]*(?:\|\||!!)[^\n]*$", re.M), 1.0),
        (re.compile(r"\[https?://[^\s\]]+\s[^\]\n]+\]"), 2.0),
        (re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|^#REDIRECT\b", re.M), 2.5),
        (re.compile(r"</?(?:ref|nowiki|gallery|references)\b[^<>\n]*>", re.I), 2.5),
    ],
    "latex": [
        (re.compile(rf"\\(?:{COMMANDS})(?![A-Za-z])\*?(?:\[[^\]\n]*\])?(?:\{{[^{{}}]*\}})?"), 2.5),
        (re.compile(r"\\[A-Za-z]{2,}\*?\{[^{}\n]*\}"), 1.5),
    ],
    "markdown": [
        (re.compile(r"(?<![*\w])(\*\*|__)(?![\s*_])(?:(?!\1|\n[ \t]*\n[ \t]*\n).)+(?<![\s*_])\1(?![*\w])", re.S), 2.5),
        (re.compile(r"(?<![*\w\\])\*(?![\s*])[^*\n]+(?<![\s*])\*(?![*\w])"), 1.2),
        (re.compile(r"(?<![_\w\\])_(?![\s_])[^_\n]+(?<![\s_])_(?![_\w])"), 1.2),
        (re.compile(r"~~(?![\s~])[^~\n]+~~"), 2.0),
        (re.compile(r"^[ \t]*#{1,6}[ \t]+(?=[^\n]*[^\W\d_]{2})\S[^\n]*$", re.M), 2.0),
        (re.compile(r"!?\[[^\[\]\n]+\](?:\([^()\s]*\)|\[[^\[\]\n]+\])", re.S), 2.5),
        (re.compile(r"!?\[[^\[\]]+\]\([^()\s]+\)"), 2.5),
        (re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n`]*$", re.M), 2.0),
        (re.compile(r"(?<!`)`(?!`)[^`\n]+`(?!`)"), 1.5),
        (re.compile(r"(?:^[ \t]*[-*+][ \t]+[^\W\d_\s][^\n]*$\n?|^[ \t]*[-*+][ \t]+\d[^\n]*[^\W\d_]{2}[^\n]*$\n?){2,}", re.M), 1.5),
        (re.compile(r"(?:^[ \t]*\d{1,3}\.[ \t]+\S[^\n]*$\n?){2,}", re.M), 1.0),
        (re.compile(r"^[ \t]*>[ \t]+(?=[^\n]*[^\W\d_]{3})\S[^\n]*$", re.M), 1.5),
        (re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?)?[ \t]*$", re.M), 2.5),
        (re.compile(r"\[\^[\w-]+\]:?"), 2.0),
    ],
}
#: Marks that don't speak for residue alone: kind, pattern, weight of the mark by itself.
WEAK: dict[str, list[tuple[re.Pattern, float]]] = {
    "html": [(re.compile(r"</?[A-Za-z][\w-]*(?:\s[^<>\n]*)?/?>"), 0.3), (re.compile(r"&[a-zA-Z]{2,8};"), 0.3)],
    "wiki": [(re.compile(r"^[ \t]*[|!][^|!\n]+$", re.M), 0.3)],
    "latex": [(re.compile(r"\\[A-Za-z]{2,}\*?(?![A-Za-z{])"), 0.2), (re.compile(r"\\\\[ \t]*$", re.M), 0.3)],
    "markdown": [(re.compile(r"^[ \t]*(?:[-*+]|\d{1,3}\.)[ \t]+\S[^\n]*$", re.M), 0.3), (re.compile(r"^[ \t]*\|[^\n]*\|[ \t]*$", re.M), 0.3)],
}
#: What speaks for content in every node, and the strength of the edges: to a mark right beside of the same markup, to one of
#: another markup, and to a partner. REACH is the distance in characters over which an edge loses two thirds of its strength.
CONTENT, NEXT, OTHER, PARTNER, REACH, TIES = 0.5, 1.0, 0.1, 2.0, 200, 3
#: One cheap test a markup has to pass before its patterns are tried.
HINT = {
    "html": re.compile(r"<[/!A-Za-z]|&[a-zA-Z#]"),
    "wiki": re.compile(r"''|==|\[\[|\{\{|\{\||\|-|\[http|__|#R|<ref|<nowiki|\|\|"),
    "latex": re.compile(r"\\[A-Za-z]"),
    "markdown": re.compile(r"[*_`#>\]~]|^[ \t]*-[ \t-]|^[ \t]*\d+\.[ \t]|^[ \t]*\|", re.M),
}
FENCED = re.compile(r"^[ \t]*(`{3,}+|~{3,}+)[^\n]*\n.*?^[ \t]*\1[`~]*[ \t]*$", re.M | re.S)
INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
FORMULA = re.compile(r"\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|(?<![\\$])\$(?![\s$])[^$\n]+?(?<![\s\\])\$(?!\$)|\\begin\{(equation|align|cases|gather|matrix|eqnarray)\*?\}.*?\\end\{\1\*?\}", re.S)
PAGE = re.compile(r"<!-- ?source:page[^>]*-->|^\[page \d+ not recognized\]$", re.M)
OWN = re.compile(r"<(pre|math|code)\b[^>]*>.*?</\1>", re.S | re.I)
BLOCK_TAG = re.compile(r"</?(?:p|li|ul|ol|table|tr|div|h[1-6]|content-ref)\b[^<>]*>|<br\s*/?>", re.I)
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
NEARBY = 60


def blanked(pattern: re.Pattern, text: str) -> str:
    """Matches become spaces of the same length, so places stay what they are; line ends stay."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", "\x00", m.group()), text)


def visible(markup: str) -> str:
    """The text a reader sees of a block, without code and formulas; entities are read once."""
    text = TAG.sub("", BLOCK_TAG.sub("\n", OWN.sub("\x00", markup) if "<pre" in markup or "<math" in markup or "<code" in markup else markup))
    return (htmllib.unescape(text) if "&" in text else text).strip("\n")


def masked(field: str, text: str) -> str:
    if field == "html":
        seen = visible(text)
        return blanked(FORMULA, seen) if "$" in seen or "\\" in seen else seen
    if "<!--" in text or "[page" in text:
        text = blanked(PAGE, text)
    if "```" in text or "~~~" in text:
        text = blanked(FENCED, text)
    if "`" in text:
        text = blanked(INLINE_CODE, text)
    return blanked(FORMULA, text) if "$" in text or "\\" in text else text


def readable(text: str, a: int, b: int, inside: str = "") -> float:
    """Share of letters and spaces around [a, b), its own marks left out, and in what a long mark holds inside."""
    near = text[max(0, a - NEARBY) : a] + text[b : b + NEARBY]
    near = near.replace("\x00", "")
    inner = text[a:b]
    near += inside or "".join(c for c in inner if c.isalpha() or c == " ")
    if not near:
        return 1.0
    return sum(c.isalpha() or c in " \n,.;:()-–’'0123456789%" for c in near) / len(near)


WORDY = re.compile(r"[A-Za-zÀ-ÿЀ-ӿ]{3,}")
VOWELS = re.compile(r"[aeiouyäöüàâéèêëîïôùûœаеёиоуыэюя]", re.I)


def voiced(text: str, a: int, b: int) -> bool:
    words = WORDY.findall(text[max(0, a - NEARBY) : b + NEARBY])
    return not words or sum(bool(VOWELS.search(w)) for w in words) * 3 >= 2 * len(words)


def nodes_of(field: str, text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, markup, cost) of every mark; a cost above 0 speaks for residue."""
    seen: list[tuple[re.Match, str, float]] = []
    for kind, patterns in MARKS.items():
        if kind == "markdown" and field != "html" or not HINT[kind].search(text):
            continue
        taken = bytearray(len(text))
        strong = len(seen)
        for pattern, weight in [*patterns, *WEAK[kind]]:
            if weight < CONTENT and len(seen) == strong:
                break  # weak marks without any other can't be residue
            for m in pattern.finditer(text):
                a, b = m.span()
                if taken.find(1, a, b) >= 0:
                    continue
                taken[a:b] = b"\1" * (b - a)
                seen.append((m, kind, weight))
    if not seen:
        return []
    # what surrounds a mark is judged without the signs of the other marks
    rest = list(text)
    for m, kind, _ in seen:
        for i in range(*m.span()):
            if kind == "html" or not (rest[i].isalnum() or rest[i].isspace()):
                rest[i] = "\x00"
    plain = "".join(rest)
    out = []
    for m, kind, weight in seen:
        a, b = m.span()
        cost = weight
        inside = m.group().strip("'*_=~[]{}|<> \n") if kind in ("wiki", "markdown") and b - a > NEARBY else ""
        if readable(plain, a, b, inside) < 0.75 or not voiced(plain, a, b):
            cost -= 4.0
        if kind == "latex":
            before = text[a - 1 : a]
            if before and (before in ":\\/._-" or before.isalnum() and "{" not in m.group() and m.group()[1:] not in ("hfill", "noindent")) or re.match(r"[\\/.]|\w*\.\w{2,4}\b", text[b : b + 8]):
                cost -= 4.0
        out.append((a, b, kind, cost))
    out.sort()
    return out


class Flow:
    """Dinic's max-flow; the source side of the cut is what remains reachable."""

    def __init__(self, n: int):
        self.edges: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[float] = []

    def add(self, a: int, b: int, cap: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, cap), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)

    def reached(self, s: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[s] = 0
        todo = deque([s])
        while todo:
            a = todo.popleft()
            for e in self.edges[a]:
                if self.cap[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    todo.append(self.to[e])
        return level

    def cut(self, s: int, t: int) -> list[bool]:
        while True:
            level = self.reached(s)
            if level[t] < 0:
                return [x >= 0 for x in level]
            at = [0] * len(self.edges)
            while True:  # one augmenting path of the level graph after the other
                path, a = [], s
                while a != t:
                    while at[a] < len(self.edges[a]):
                        e = self.edges[a][at[a]]
                        if self.cap[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                            break
                        at[a] += 1
                    else:
                        if a == s:
                            break
                        e = path.pop()
                        a = self.to[e ^ 1]
                        at[a] += 1
                        continue
                    path.append(e)
                    a = self.to[e]
                if a != t:
                    break
                push = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= push
                    self.cap[e ^ 1] += push


TAG_OF = re.compile(r"(?:<|&(?:amp;)*lt;)(/?)([A-Za-z][\w-]*)")


def partners(text: str, nodes: list[tuple[int, int, str, float]]) -> list[tuple[int, int]]:
    """Pairs of an opening and a closing tag of one name, the nearest first."""
    out, opened = [], {}
    for i, (a, b, kind, _) in enumerate(nodes):
        if kind == "html" and (m := TAG_OF.match(text, a, b)):
            if not m[1]:
                opened.setdefault(m[2].lower(), []).append(i)
            elif opened.get(m[2].lower()):
                out.append((opened[m[2].lower()].pop(), i))
    return out


def edges(text: str, nodes: list[tuple[int, int, str, float]]) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the TIES marks before, weaker with their distance and over the end of an element, and to partners.

    A line of a block's visible text is an element of its own; in a body a paragraph is.
    """
    out = [(i, j, PARTNER) for i, j in partners(text, nodes)]
    before: list[int] = []
    for j, (a, _, kind, _) in enumerate(nodes):
        for i in before[-TIES:]:
            end = nodes[i][1]
            between = text[end:a] if end < a else ""
            element = 1.0 if "\n" not in between else 0.6 if "\n\n" not in between else 0.3
            tie = (NEXT if nodes[i][2] == kind else OTHER) * exp(-len(between) / REACH) * element
            if tie > 0.01:
                out.append((i, j, tie))
        before.append(j)
    return out


def residue(field: str, text: str, tied: bool = True) -> list[tuple[int, int, str]]:
    """The marks that the minimum cut leaves on the side of residue, of a masked text; tied=False leaves the edges out."""
    nodes = nodes_of(field, text)
    if not nodes:
        return []
    n = len(nodes)
    flow = Flow(n + 2)
    s, t = n, n + 1
    for i, (_, _, _, cost) in enumerate(nodes):
        if cost > 0:
            flow.add(s, i, cost)
        flow.add(i, t, CONTENT - min(0.0, cost))
    for i, j, tie in edges(text, nodes) if tied else ():
        flow.add(i, j, tie, tie)
    side = flow.cut(s, t)
    return [(a, b, kind) for (a, b, kind, _), x in zip(nodes, side) if x]


def marks(field: str, rec: int, text: str):
    found: dict[str, int] = {}
    for _, _, kind in residue(field, masked(field, text)):
        found[kind] = found.get(kind, 0) + 1
    for kind, n in found.items():
        yield field, rec, kind, n


def markup_residue(records: DataFrame) -> DataFrame:
    """(field_name, rec_id, markup, n_marks) of records (field_name, rec_id, text); one row per foreign markup of a record."""
    return C.once(C.arrow_rows(C.narrow(records), marks, SCHEMA), "field_name", "rec_id", "markup")


#: Tags as Markdown, opening and closing; what isn't named goes.
AS_MARKDOWN = {
    "li": ("\n- ", ""), "br": ("\n", "\n"), "hr": ("\n---\n", ""), "p": ("", "\n"), "div": ("", "\n"), "ul": ("", "\n"), "ol": ("", "\n"), "table": ("", "\n"), "blockquote": ("\n> ", "\n"), "section": ("", "\n"),
    "tr": ("", "|\n"), "td": ("| ", " "), "th": ("| ", " "), "dt": ("\n", ""), "dd": ("\n", ""), "pre": ("\n```\n", "\n```\n"), "code": ("`", "`"), "tt": ("`", "`"), "kbd": ("`", "`"),
} | {f"h{k}": ("\n" + "#" * k + " ", "\n") for k in range(1, 7)}


def html_mark(mark: str) -> str:
    while (plain := htmllib.unescape(mark)) != mark and not mark.startswith("<"):
        mark = plain
    if mark.startswith("<!"):
        return ""
    if not (m := TAG_OF.match(mark)):
        return mark.replace("\u00a0", " ")
    if m[2].lower() == "img":
        return alt[1] if (alt := re.search(r"alt=[\"']([^\"']*)", mark)) else ""
    return AS_MARKDOWN.get(m[2].lower(), ("", ""))[bool(m[1])]


def wiki_mark(mark: str) -> str:
    core = mark.strip()
    if m := re.fullmatch(r"(={2,6})[ \t]*(.+?)[ \t]*\1", core):
        return "#" * len(m[1]) + " " + m[2]
    if m := re.fullmatch(r"('{2,5})(.+?)\1", core, re.S):
        return m[2]
    if core.startswith("[["):
        return "" if re.match(r"\[\[(?:File|Image|Datei|Fichier|Файл):", core) else core[2:-2].rpartition("|")[2]
    if m := re.fullmatch(r"\[https?://\S+\s(.+)\]", core):
        return m[1]
    if core.startswith(("{{", "{|", "|}", "|-", "__", "#RED", "<")):
        return ""
    if core.startswith("|+"):
        return core[2:].strip()
    return "| " + re.sub(r"\s*(?:\|\||!!)\s*", " | ", core[1:].strip()) + " |" if core[:1] in "|!" else mark


LATEX = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?(?:\{([^{}]*)\})?$", re.S)
DEPTH = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6, "title": 1}
GOES = frozenset("cite citep citet label includegraphics vspace hspace index input include usepackage documentclass url date".split())


def latex_mark(mark: str) -> str:
    m = LATEX.match(mark)
    if not m:
        return "\n" if mark.startswith("\\\\") else mark
    name, arg = m[1], m[2]
    if name in DEPTH and arg is not None:
        return "\n" + "#" * DEPTH[name] + f" {arg}\n"
    if name in ("begin", "end"):
        return "\n```\n" if arg in ("verbatim", "lstlisting") else ""
    if name == "item":
        return "\n- "
    if name in GOES:
        return ""
    if name in ("ref", "eqref", "pageref"):
        return f"({arg})" if name == "eqref" else arg or ""
    if name == "footnote":
        return f" ({arg})" if arg else ""
    if name == "href":
        return ""
    return {"ldots": "…", "dots": "…", "LaTeX": "LaTeX", "TeX": "TeX", "newline": "\n", "linebreak": "\n", "par": "\n\n", "hline": ""}.get(name, arg or "")


def closing(text: str, at: int) -> int:
    """The place of the brace that closes the one at `at`; -1 if none does."""
    depth = 0
    for m in re.compile(r"\\?[{}]").finditer(text, at):
        if m.group()[0] != "\\":
            depth += 1 if m.group() == "{" else -1
            if not depth:
                return m.start()
    return -1


def rewritten(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with its residue as Markdown: every mark by what it means, braces of commands with it; all else as it stands."""
    edits: list[tuple[int, int, str]] = []
    for a, b, kind in found:
        mark = text[a:b]
        if kind == "html":
            edits.append((a, b, html_mark(mark)))
        elif kind == "wiki":
            edits.append((a, b, wiki_mark(mark)))
        elif kind == "latex":
            new = latex_mark(mark)
            if text[a - 1 : a] == "~" and not new:
                a -= 1
            if "{" not in mark:
                if text[b : b + 1] == "{" and (end := closing(text, b)) > 0:
                    edits.append((end, end + 1, ""))
                    m = LATEX.match(mark)
                    new, b = "\n" + "#" * DEPTH[m[1]] + " " if m and m[1] in DEPTH else new, b + 1
                elif text[a - 1 : a] == "{" and (end := closing(text, a - 1)) > 0:
                    edits.append((end, end + 1, ""))
                    a -= 1
                b += text[b : b + 1] == " "
            elif mark.startswith(("\\href", "\\begin{tab", "\\multicolumn")) and text[b : b + 1] == "{" and (end := closing(text, b)) > 0:
                edits += [(b, b + 1, ""), (end, end + 1, "")] if mark.startswith("\\href") else [(b, end + 1, "")]
            edits.append((a, b, new))
    out: list[str] = []
    at = 0
    for a, b, new in sorted(edits):
        if a < at:
            continue
        out.append(text[at:a])
        head = next((x for x in reversed(out) if x), "\n")
        # line ends that a mark brings along don't add to those that are there
        if new.startswith("\n") and head.endswith("\n"):
            new = new.lstrip("\n")
        if (new or head).endswith("\n") and text[b : b + 1] == "\n":
            b += 1
        out.append(new)
        at = b
    return "".join(out) + text[at:]


#: A block's own headings, items and rows while its text is judged: a line of one sign after which the block's line follows.
OWN_START = {"li": "\ue100", "tr": "\ue101"} | {f"h{k}": chr(0xE101 + k) for k in range(1, 7)}
OWN_LINE = re.compile("\n*([\ue100-\ue107])\n*")
CELL = "\x1f"


def outlined(markup: str) -> tuple[str, list[str]]:
    """The visible text of a block with signs for its own structure, and its own code and formulas as Markdown."""
    held: list[str] = []

    def own(m: re.Match) -> str:
        inner = htmllib.unescape(TAG.sub("", re.sub(r"^<[^>]*>|</[^<>]*>$", "", m.group())))
        block = "block" in m.group()[: m.group().index(">")]
        held.append({"pre": f"\n```\n{inner}\n```\n", "code": f"`{inner}`"}.get(m[1].lower(), f"$$ {inner} $$" if block else f"${inner}$"))
        return "\x00"

    def block(m: re.Match) -> str:
        t = TAG_OF.match(m.group())
        return f"\n{OWN_START[t[2].lower()]}\n" if not t[1] and t[2].lower() in OWN_START else "\n"

    text = OWN.sub(own, markup.replace("\x00", ""))
    text = TAG.sub("", re.sub(r"</t[dh]>", CELL, BLOCK_TAG.sub(block, text), flags=re.I))
    return htmllib.unescape(text), held


def finished(text: str, held: list[str]) -> str:
    """Signs of a block's own structure as Markdown; the first row of a table gets a rule below it."""
    text = OWN_LINE.sub(lambda m: "\n" + ("- " if m[1] == "\ue100" else CELL if m[1] == "\ue101" else "#" * (ord(m[1]) - 0xE101) + " "), text)
    lines: list[str] = []
    rows = 0
    for line in text.split("\n"):
        if CELL in line:
            cells = [c.strip() for c in line.strip(CELL + " ").split(CELL)]
            lines += ["| " + " | ".join(cells) + " |"] + (["|" + " --- |" * len(cells)] if not rows else [])
            rows += 1
        else:
            rows = rows if not line.strip() and rows else 0
            if line.strip() or not rows:
                lines.append(line)
    parts = "\n".join(lines).split("\x00")
    text = parts[0] + "".join(a + b for a, b in zip(held, parts[1:]))
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


def cleaned(field: str, rec: int, text: str):
    held: list[str] = []
    if field == "html":
        text, held = outlined(text)
        seen = blanked(FORMULA, text) if "$" in text or "\\" in text else text
    else:
        seen = masked(field, text)
    found = residue(field, seen)
    text = rewritten(text, found)
    yield field, rec, sorted({kind for _, _, kind in found}), finished(text, held) if field == "html" else text


def clean_text(records: DataFrame) -> DataFrame:
    """(field_name, rec_id, markups, clean): every record as clean Markdown."""
    return C.once(C.arrow_rows(C.narrow(records), cleaned, CLEAN), "field_name", "rec_id")


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.bodies(spark, sf_dir).unionByName(C.block_html(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_text(both(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_residue(both(spark, sf_dir)).select("field_name", "rec_id", "markup")
