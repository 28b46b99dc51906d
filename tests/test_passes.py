"""The passes of the cleaning chain, findings and edit lists, one rule at a time: what fires, and what must not."""

import random
from collections import Counter

import pytest

from quire.operators import cleaning, findings, formulas, grids, headings, inspection, layout, lists, post, prose
from quire.operators.zones import read, segments
from quire.sources import engines


def segs(text):
    return [[x, False] for x in text.split("\n")]


def text(s):
    return "\n".join(x for x, _ in s)


def kinds(body):
    return [(line, kind) for line, kind, _ in findings.of(body)]


@pytest.mark.parametrize(
    "body, protected",
    [
        ("---\ntitle: x\n---\na", [0, 1, 2]),
        ("---\na", []),
        ("````\n```\na\n````\nb", [0, 1, 2, 3]),
        ("```\n~~~\na\n```\nb", [0, 1, 2, 3]),
        ("~~~ text\na\n~~~ more\nb", [0, 1, 2, 3]),
        ("``` a`b\nc", []),
        ("<table>\n<tr>\n</table>\nz", [0, 1, 2]),
        ("</table>\nz", [0]),
        ("", []),
    ],
)
def test_zones(body, protected):
    assert [i for i, (_, p) in enumerate(segments(body)) if p] == protected


def test_underlines_and_pages():
    rows = list(read("Title\n===\n\n===\n# H\n---\n<!-- source:page 4 -->\nx $$\ny\n$$ z"))
    assert [r[0] for r in rows if r[5]] == [1] and [r[0] for r in rows if r[3]] == [7, 8, 9] and rows[9][4] == 4 and rows[0][4] is None


def test_chain_keeps_underlines_of_headings():
    assert cleaning.cleaned("Title\n===\n\n===\n") == "Title\n===\n"


def test_trim_leaves_formulas_and_tables():
    matrix = "$$\na & b\na & b\na & b\n$$\n"
    assert cleaning.trim_repeats(segs(matrix)) == segs(matrix)
    table = "| a |\n\n| a |\n\n| a |"
    assert cleaning.trim_repeats(segs(table)) == segs(table)
    assert text(cleaning.trim_repeats(segs("p\n\nq\n\nq\n\nq\n\nr"))) == "p\n\nq\n\nr" and text(cleaning.trim_repeats(segs("a\nb\nb\nb\nc"))) == "a\nb\nc"


def test_unsettled_bodies_say_so(monkeypatch):
    monkeypatch.setattr(cleaning, "one_round", lambda t: t + "x")
    with pytest.raises(cleaning.Unsettled):
        cleaning.cleaned("a")


def test_spans_and_soundness():
    assert formulas.spans(r"a $x_1$ and \$5 or `$y$` $$z$$") == [(2, 7), (25, 30)]
    assert formulas.spans(r"open $\alpha + 1") == [(5, 16)] and formulas.spans("costs 5$ and 6$") == []
    sound = [r"\frac{a}{b}", r"\left( x \right)", r"\begin{cases} a & b \\ c & d \end{cases}", "x_1^2"]
    broken = ["", " ", r"\frac{a}{b", r"\left( x", "a & b", r"\begin{array} a", r"x \end{array}", "a^", "}{"]
    assert all(map(formulas.is_sound, sound)) and not any(map(formulas.is_sound, broken))


@pytest.mark.parametrize(
    "old, new",
    [
        (r"x \eqno(3)", r"x \tag{3}"),
        (r"\mbox{a} b", r"\text{a} b"),
        (r"a_{1}_{2}", r"a_{1}{}_{2}"),
        (r"a \label{eq:1}", "a"),
        ('f" = 0', "f'' = 0"),
        (r"a & b \end{array}", "a  b"),
        (r"a + b \\", "a + b"),
        (r"\frac{a}{b}", r"\frac{a}{b}"),
    ],
)
def test_formula_content(old, new):
    assert formulas.fixed(old).strip() == new


@pytest.mark.parametrize(
    "old, new",
    [
        ("$$a = b +$$\n\n$$+ c$$", "$$a = b + c$$"),
        ("$$a = b.$$\n\n$$c = d$$", "$$a = b.$$\n\n$$c = d$$"),
        ("$$a = b$$\n(12)", "$$a = b \\tag{12}$$"),
        ("$$a = b \\quad (4)$$", "$$a = b \\quad \\tag{4}$$"),
        ("$$a = b$$\n.", "$$a = b.$$"),
        ("of $\\varnothing$ 5 and $x$", "of ∅ 5 and $x$"),
        ("is 3$S$ long", "is 3 $S$ long"),
        ("costs $5$ each", "costs $5$ each"),
        ("$\\left( x$", "$\\left( x \\right.$"),
        ("| $$a|b$$ | c |", "| $a\\vert b$ | c |"),
        ("$\\begin{tabular}{l} a \\end{tabular}$", "\\begin{tabular}{l} a \\end{tabular}"),
        ("$x<sup>2</sup> + 1$", "$x^{2} + 1$"),
        ("x\n\n$E = m c^2 + p_0 + q$\n\ny", "x\n\n$$E = m c^2 + p_0 + q$$\n\ny"),
        ("$$p \\text{ — the measured pressure of the upper valve}$$", "$p$ — the measured pressure of the upper valve"),
        ("$$a = b$$ where the valve is", "$$a = b$$\n\nwhere the valve is"),
    ],
)
def test_formula_passes(old, new):
    assert text(formulas.mended(segs(old))) == new


def test_reclosed_and_stubs():
    assert text(formulas.reclosed(segs("$$\na = b \\\\$$\nc"))) == "$$\na = b$$\nc"
    assert text(formulas.stubs_cut(segs("so $a = b \\begin{array}{l} c$ is"))) == "so $a = b$ is" and text(formulas.stubs_cut(segs("so $\\begin{array}{l} c$ is"))) == "so  is"


def brute_repeats(line, low, high, times):
    return any(line[i : i + p] * times == line[i : i + p * times] and line[i : i + p].strip() for p in range(low, high + 1) for i in range(len(line) - p * times + 1))


def test_loops():
    random.seed(3)
    for _ in range(200):
        line = "".join(random.choice("ab ") for _ in range(random.randint(0, 20))) + "".join(random.choice("abc") for _ in range(4)) * random.randint(1, 8)
        assert bool(formulas.looped(line, 3, 80, 6)) == brute_repeats(line, 3, 12, 6)
    assert formulas.without_loops("see $" + "a + b " * 9 + "c$ end") == "see $a + b c$ end"
    assert formulas.without_loops("the valve " * 12 + "end") == "the valve end" and formulas.without_loops("no no no no no no ok") == "no no no no no no ok"
    assert formulas.without_loops("1 2 3 " * 20) == "1 2 3 " * 20
    line = "$a$, $b$, " * 7
    assert [line[a:b] for a, b in formulas.repeated_spans(line)] == [", $a$, $b$" * 6] and formulas.repeated_spans("$a$ $b$ $c$") == []


@pytest.mark.parametrize(
    "old, new",
    [
        ("- 1. one\n- 2. two\n  - x\n- 3. three", "1. one\n2. two\n   - x\n3. three"),
        ("- 1. one\n- 3. three", "- 1. one\n- 3. three"),
        ("a) one\n  b) two", "a) one\nb) two"),
        ("- one\n- two\n  - three", "- one\n- two\n- three"),
        ("- one\n  - two\n- three", "- one\n  - two\n- three"),
        ("- 1. one\n\n- 2. two", "1. one\n\n2. two"),
        ("text\n- one", "text\n- one"),
    ],
)
def test_lists(old, new):
    assert text(lists.normalized(segs(old))) == new


def test_stray_bullets():
    assert text(lists.without_stray_bullets(segs("a ❚\n❚\nb"))) == "a\nb"


@pytest.mark.parametrize(
    "old, new",
    [
        ("| No. | Size | No. | Size |\n|---|---|---|---|\n| 1 | a | 3 | c |\n| 2 | b |  |  |", "| No. | Size |\n| --- | --- |\n| 1 | a |\n| 2 | b |\n| 3 | c |"),
        ("| 1 | 2 | 1 | 2 |\n|---|---|---|---|\n| x | a | y | c |", "| 1 | 2 | 1 | 2 |\n| --- | --- | --- | --- |\n| x | a | y | c |"),
        ("| 1 Valves .... 3<br>1.1 Upper .... 4 |\n|---|\n| 2 Shafts .... 9 |", "1 Valves 3\n1.1 Upper 4\n2 Shafts 9"),
        ("| A | B | 1<br>x<br>2<br>y<br>3<br>z<br>4<br>w |\n|---|---|---|", "| A | B |\n| --- | --- |\n| 1 | x |\n| 2 | y |\n| 3 | z |\n| 4 | w |"),
        ("| a | b | c |\n|---|---|---|\n| x | 1 | 2 |\n| y | 3 4 |  |", "| a | b | c |\n| --- | --- | --- |\n| x | 1 | 2 |\n| y | 3 | 4 |"),
        ("| a | b | c |\n|---|---|---|\n| x | 1 | 2 |\n| y | 17 440 |  |", "| a | b | c |\n| --- | --- | --- |\n| x | 1 | 2 |\n| y | 17 440 |  |"),
        ("| key | long column text |\n|---|---|\n| a | the first line of the |\n|  | second half |", "| key | long column text |\n| --- | --- |\n| a | the first line of the second half |"),
        ("| a | b |\n| c | d |", "| a | b |\n| --- | --- |\n| c | d |"),
        ("|---|---|\n| a | b |\n| c | d |", "| a | b |\n| --- | --- |\n| c | d |"),
    ],
)
def test_grids(old, new):
    assert text(grids.repaired(segs(old))) == new


def test_spread_by_forms():
    head, body = ["n", "a", "b", "c", "d"], [["x", "1,5", "12", "A7", "9"], ["y", "2,5", "14", "B8", "8"], ["z", "", "3,5 17", "", ""]]
    assert grids.spread(head, [list(r) for r in body])[2] == ["z", "3,5", "17", "", ""]
    assert grids.spread(head, [list(r) for r in body[:2]] + [["z", "", "3 17", "", ""]])[2] == ["z", "", "3 17", "", ""]


def test_layout_of_tables():
    assert text(grids.laid_out(segs("| a | b |\n|:-|---|\n| xxxx | 1 |"))) == "| a    | b   |\n| :--- | --- |\n| xxxx | 1   |"
    wide = "| " + "x" * 130 + " | b |\n|---|---|\n| 1 | 2 |"
    assert text(grids.laid_out(segs(wide))).split("\n")[2] == "| 1 | 2 |"
    assert text(grids.glued_headers(segs("The values of it: | a | b |\n|---|---|"))) == "The values of it:\n\n| a | b |\n|---|---|"


def test_contents_as_witness():
    s = segs("# Contents\n\n1 Valves ..... 3\n1.1 Upper valves ..... 4\n2 Shafts ..... 9\n\n# Valves\n\n# Upper valves\n\n# Shafts\n\n# Note")
    assert headings.records(s) == [(1, "valves"), (2, "upper valves"), (1, "shafts")]
    assert headings.outlined(s, headings.records(s)) == {6, 8, 10}
    assert [x for x, _ in s if x.startswith("#")] == ["# Contents", "# Valves", "## Upper valves", "# Shafts", "## Note"]
    assert headings.records(segs("# Contents\n\nValves ..... 3\nShafts ..... 9")) == []
    assert text(headings.one_contents_heading(segs("# Contents\na .... 3\n# CONTENTS\nb .... 4"))) == "# Contents\na .... 3\nb .... 4"


def test_lost_and_unstyled_headings():
    assert text(headings.lost(segs("# 1 A\n\n## 1.1 B\n\n1.2 The C\n\n## 1.3 D"))) == "# 1 A\n\n## 1.1 B\n\n## 1.2 The C\n\n## 1.3 D"
    for other in ("# 1 A\n\n## 1.1 B\n\n1.4 The C\n\n## 1.3 D", "# 1 A\n\n## 1.1 B\n\nx\n1.2 The C\n\n## 1.3 D", "# 1 A\n\n## 1.1 B\n\n2.1 The C"):
        assert text(headings.lost(segs(other))) == other
    assert text(headings.unstyled(segs("**1 A**\n\nx\n\n**2 B**\n\ny\n\n**3 C**"))) == "# 1 A\n\nx\n\n# 2 B\n\ny\n\n# 3 C"
    assert text(headings.unstyled(segs("THE VALVE\n\nx\n\nTHE SHAFT\n\ny\n\nTHE QUAY\n\nz"))) == "## THE VALVE\n\nx\n\n## THE SHAFT\n\ny\n\n## THE QUAY\n\nz"
    assert text(headings.unstyled(segs("# H\n\n**1 A**\n\n**2 B**\n\n**3 C**"))) == "# H\n\n**1 A**\n\n**2 B**\n\n**3 C**"


def test_levels():
    assert text(headings.number_forms(segs("# A\n### (1) x\n## (2) y"))) == "# A\n## (1) x\n## (2) y"
    assert text(headings.nested(segs("# 1 A\n# Note\n# 2 B\n# References"), set())) == "# 1 A\n## Note\n# 2 B\n# References"
    assert text(headings.voted(segs("## Note\n## Note\n# Note"), set())) == "## Note\n## Note\n## Note" and text(headings.voted(segs("## Note\n# Note"), set())) == "## Note\n# Note"
    assert text(headings.gaps_closed(segs("# A\n### B\n### C\n# D"), set())) == "# A\n## B\n## C\n# D"


def test_spaced_titles():
    assert headings.fewest("overthe", Counter(["over", "the"])) == ["over", "the"] and headings.fewest("abab", Counter(["a", "bab", "aba", "b"])) is None
    s = segs("# I n t r o d u c t i o n\n\nthe introduction is here")
    assert headings.spaced_titles(s)[0][0] == "# Introduction" and headings.spaced_titles(segs("# A b c of d"))[0][0] == "# A b c of d"


def test_prose_passes():
    assert prose.roman_joined("V II.11 and A I.2") == "VII.11 and A I.2" and prose.roman_joined("II VX.1") == "II VX.1"
    assert prose.decimals_joined("| 36. 90 | in 12. 5 % of 1 250. 75") == "| 36.90 | in 12.5 % of 1 250.75" and prose.decimals_joined("in 1990. 12 men") == "in 1990. 12 men"
    assert text(prose.compounds_settled(segs("ice-cold icecold icecold icecold"))) == "icecold icecold icecold icecold" and text(prose.compounds_settled(segs("ice-cold ice-cold ice-cold icecold"))) == "ice-cold ice-cold ice-cold ice-cold"
    assert text(prose.compounds_settled(segs("ice-cold icecold"))) == "ice-cold icecold"
    assert text(prose.spaced_joined(segs("a valve and valve: v a l v e, x y z"))) == "a valve and valve: valve, x y z"
    assert text(prose.tokens_repaired(segs("turbine " * 20 + "Turbino"))).endswith(" Turbine") and text(prose.tokens_repaired(segs("turbine " * 19 + "turbino"))).endswith("turbino")
    long = "**" + "The valve was closed by hand before noon. " * 4 + "**"
    assert "**" not in text(prose.emphasis_dropped(segs(long))) and text(prose.emphasis_dropped(segs("**Short.** And then."))) == "**Short.** And then."
    crushed = "\n\n".join(["The men went", "to the river", "and came back.", "Then it", "rained all", "night long."])
    assert text(prose.crushed_joined(segs(crushed))) == "The men went to the river and came back.\n\nThen it rained all night long."


def test_furniture():
    page = lambda k: f"Old Quay Report\n{k}\n" + "\n".join(f"The text of page {k} and line {i} goes on here." for i in range(30))
    body = "\n".join(page(k) for k in range(5))
    assert "Old Quay Report" not in text(prose.without_furniture(segs(body))) and "\n3\n" not in text(prose.without_furniture(segs(body)))
    close = "\n".join(f"Old Quay Report\n{k}\nx y." for k in range(5))
    assert text(prose.without_furniture(segs(close))) == close


def test_findings():
    assert kinds("The va-\nlve") == [(0, "hyphenation")] and kinds("The va-\n\n\n![x](y.png)\nlve") == [(0, "hyphenation-gap")] and kinds("The va-\nValve") == [] and kinds("```\nva-\nlve\n```") == []
    assert kinds("\n".join(["ab"] * 6)) == [(0, "flattened-block")] and kinds("\n".join(["- ab"] * 6)) == []
    assert kinds("# A Title of the Valve. Then comes more prose") == [(0, "run-in-heading")] and kinds("# " + "valve " * 40) == [(0, "flattened-block")]
    assert kinds("see $" + "a + b " * 9 + "c$") == [(0, "broken-formula")] and kinds("see $\\begin{array}{l} x$") == [(0, "broken-formula")] and kinds("see $a + b$") == []
    assert kinds("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |") == [(3, "broken-table")] and kinds("a v a l v e b") == [(0, "letter-spacing")]
    assert kinds("") == []


def edit(line, old, new, page=None):
    return {"page": page, "line": line, "old": old, "new": new}


def outcomes(body, *edits, source=""):
    new, rows = inspection.applied(body, list(edits), source)
    return new, [what for _, _, what in rows]


def test_edits_are_placed():
    body = "the teh valve\nthe quay\n<!-- source:page 2 -->\nteh end\nlast"
    assert outcomes(body, edit(1, "teh", "the")) == (body.replace("the teh valve", "the the valve"), ["applied"])
    assert outcomes(body, edit(2, "end", "rim", 2))[0].endswith("teh rim\nlast") and outcomes(body, edit(99, "last", "lost", 2))[1] == ["applied"]
    assert outcomes(body, edit(2, "teh", "the"))[1] == ["several places"] and outcomes(body, edit(2, "nothing", "x"))[1] == ["no such text"]
    assert outcomes(body, edit(1, "x", "y", 9), edit(None, "teh", "the"), edit(1, "a", None), edit(1, "a", "a"))[1] == ["no address", "no address", "no text", "no change"]
    assert outcomes("```\nteh\n```", edit(2, "teh", "the"))[1] == ["protected"]


def test_edits_on_one_line():
    assert outcomes("teh valve adn quay", edit(1, "teh", "the"), edit(1, "adn", "and")) == ("the valve and quay", ["applied", "applied"])
    assert outcomes("teh valve", edit(1, "teh", "the"), edit(1, "teh valve", "a valve"))[1] == ["applied", "conflict"]


@pytest.mark.parametrize(
    "old, new, why",
    [
        ("12 bar", "13 bar", "digits changed"),
        ("so $a + b$ is", "so $a - b$ is", "formula changed"),
        ("so $\\frac{a$ is", "so $\\frac{a}{b}$ is", None),
        ("![x](a.png) t", "![x](b.png) t", "image changed"),
        ("| a | b |", "| a b |", "row shape changed"),
        ("| a | b |", "| b | b |", "cells made equal"),
        ("## Title", "# Title", "heading mark changed"),
        ("a<sup>x</sup> b", "ax b", "inline markup changed"),
        ("a valve", "**a valve", "inline markup changed"),
        ("the val-", "the val", "line break hyphen lost"),
        ("the valve", "the \\foo valve", "new command"),
        ("the valve", "the valve\\n", "literal escape"),
        ("the valve", 'the "old": valve', "reply syntax"),
        ("the valve", "broken-table valve", "defect name"),
        ("$$x$$", "so $x$ it", "formula changed"),
        ("$$\\frac{a$$", "\\frac{a", "display line changed"),
        ("the into valve", "the in to valve", "word split"),
        ("the icecold valve", "the ice-cold valve", "word broken"),
        ("teh valve", "the valve", None),
    ],
)
def test_guards(old, new, why):
    assert inspection.rejection(old, new, inspection.witness(old)) == why


def test_witnesses_lift_bans():
    words = inspection.witness("the into valve", "he went in to it, ice-cold")
    assert inspection.rejection("the into valve", "the in to valve", words) is None and inspection.rejection("icecold", "ice-cold", words) is None


def test_masks_and_replies():
    shown, held = inspection.masked(["so $a + b$ and $\\frac{a$"], [False])
    assert shown == ["so ⟦valid formula 1⟧ and $\\frac{a$"] and inspection.unmasked(shown[0], held) == "so $a + b$ and $\\frac{a$" and inspection.unmasked("⟦valid formula 7⟧", held) is None
    assert outcomes("so $a + b$ adn it", edit(1, "⟦valid formula 1⟧ adn", "⟦valid formula 1⟧ and")) == ("so $a + b$ and it", ["applied"])
    assert [e["new"] for e in inspection.decoded('```json\n[{"page":1,"line":2,"old":"a","new":"b"},]\n```')] == ["b"] and inspection.decoded('[{"old":"\\alpha","new":"x"}]')[0]["new"] == "x"
    assert inspection.decoded("nothing") == [] and inspection.decoded(None) == [] and inspection.decoded('[{"old": 3}]') == []
    assert inspection.addresses(["a", "<!-- source:page 2 -->", "b"]) == ["0.1: a", "2.1: <!-- source:page 2 -->", "2.2: b"]


def test_edited_bodies(spark):
    bodies = spark.createDataFrame([(1, "teh valve"), (2, None)], "result_id bigint, body string")
    edits = spark.createDataFrame([(1, 1, None, 1, "teh", "the"), (2, 2, None, 1, "a", "b"), (3, 9, None, 1, "a", "b"), (4, None, None, 1, "a", "b")], "reply_id bigint, result_id bigint, page int, line int, old_text string, new_text string")
    text, what = inspection.edited(bodies, edits)
    assert [tuple(r) for r in text.collect()] == [(1, "the valve")]
    assert {(r.reply_id, r.outcome) for r in what.collect()} == {(1, "applied"), (2, "no body"), (3, "no body")}


def test_heights():
    assert layout.clusters([20, 20, 14, 14, 14, 10, 10.2]) == [1, 1, 2, 2, 2, 3, 3] and layout.clusters([12]) == [1] and layout.clusters([]) == []
    random.seed(7)
    for _ in range(30):
        h = [random.choice([8, 10, 14, 20]) for _ in range(12)]
        want = {v: k + 1 for k, v in enumerate(sorted(set(h), reverse=True))}
        assert layout.clusters(h) == [want[v] for v in h]


def test_zones_to_mend():
    body = "# A\n### B\n\nThe men went\n\nto the river\n\nand came back.\n\nThen it\n\nrained all\n\nnight long.\n\n$$the men went to the river$$\n\nso $\\frac{a$ is\n\n| a | b |\n|---|---|\n| 1 |\n| 1 | 2 |\n\na v a l v e b"
    assert [(k, a, b) for k, a, b, _ in post.zones(body)] == [("ladder", 0, 1), ("crushed", 3, 13), ("swallowed", 15, 15), ("formula", 17, 17), ("table", 19, 22), ("spacing", 24, 24)]
    assert list(post.zones("# A\n## B\n\nA valve.")) == [] and list(post.zones("")) == []


@pytest.mark.parametrize(
    "kind, old, new, why",
    [
        ("crushed", "The men went\n\nto the ri-\n\nver.", "The men went to the river.", None),
        ("crushed", "The men went\n\nto the river.", "The men went to the quay.", "content changed"),
        ("crushed", "The men\n\nwent.", "", "empty"),
        ("crushed", "The men\n\nwent.", "The men\n\nwent.", "echo"),
        ("crushed", "The men\n\nwent.", "The men | went.", "new bars"),
        ("crushed", "The val-\n\nves went.", "The valves went.", "word not attested"),
        ("crushed", "The men\n\nwent.", "```\nThe men went.\n```", "protected"),
        ("swallowed", "$$x = 1 the men went to it$$", "$x = 1$ the men went to it", None),
        ("swallowed", "$$x = 1 the men went to it$$", "$x = 2$ the men went to it", "content changed"),
        ("formula", "so $\\frac{a$ is", "so $\\frac{a}{}$ is", None),
        ("formula", "so $\\frac{a$ is", "so $\\frac{b}{}$ is", "content changed"),
        ("formula", "so $\\frac{a$ is", "so $\\frac{a{$ is", "not sound"),
    ],
)
def test_block_verdicts(kind, old, new, why):
    assert post.block_verdict(kind, old, new, Counter(["river"])) == why


def test_table_and_spacing_verdicts():
    table = "| a | b |\n|---|---|\n| 1 2 |  |"
    assert post.table_verdict(table, "| a | b |\n|---|---|\n| 1 | 2 |") is None and post.table_verdict(table, "| a | b |\n|---|---|\n| 2 | 1 |") == "values moved"
    assert post.table_verdict(table, "| a | b |\n|---|---|\n| 1 | 3 |") == "values changed" and post.table_verdict(table, "| a | b |\n|---|---|\n| 1 2 |") == "wrong width" and post.table_verdict(table, None) == "rows changed"
    assert post.respaced("a v a l v e b", "a valve b") == "a valve b" and post.respaced("a v a l v e b", "avalveb") == "avalveb" and post.respaced("the v a l v e", "thevalve") is None and post.respaced("a v a l v e", "a valse") is None


def test_ladders():
    heads = [(1, "A"), (3, "B"), (3, "C"), (1, "D")]
    assert post.ladder_needs_repair(heads) and not post.ladder_needs_repair([(1, "A"), (2, "B")]) and post.ladder_needs_repair([(1, "A"), (2, "a")])
    assert post.relevelled(heads, [(1, 2, "B"), (2, 2, "C")]) == ([1, 2, 3, 1], ["regression"])  # a level in use isn't emptied
    levels, why = post.relevelled([(1, "A"), (2, "B"), (2, "C")], [(9, 1, "x"), (1, 2, "other"), (1, 7, "B"), (1, 5, "B"), (2, 4, "C")])
    assert levels == [1, 2, 2] and why == ["no such heading", "other title", "no such level", "too far", "regression"]


def test_small_rules():
    assert formulas.unpaired("a $ b") and not formulas.unpaired("a $b$ `$` \\$")
    rule = prose.word_pattern(["fig.", "tab*", "valve"])
    assert [bool(rule.search(x)) for x in ("see Fig. 3", "figs", "tables", "valves", "a valve")] == [True, False, True, False, True] and not prose.word_pattern([]).search("x")
    assert text(prose.fabrications_dropped(segs("A [map](http://x) of ![q](y.png) it\n[Image: a quay]\n![z](w.png)\n[1]: http://a\n[2]: http://b\nsee [2]\nFigure 3. The quay\n[Figure: figure the quay]"))) == "A map of  it\n[2]: http://b\nsee [2]\nFigure 3. The quay\n[Figure: figure the quay]"
    assert text(grids.entries_whole(segs("| 1 | The upper<br>valve | 3 |\n| 2 | The lower |  |\n|  | shaft | 4 |"))) == "| 1 | The upper valve | 3 |\n| 2 | The lower shaft | 4 |"
    assert grids.math_cells_open([["<td>$$x$$</td>", True]]) == [["<td>\n\n$$x$$\n\n</td>", True]]
    assert cleaning.final_lines(segs("\n\na\n\n\nb\n")) == [None, None, 0, 1, None, 2, None]
    assert inspection.units(["a", "$$", "x", "$$", "$$y$$"], [False] * 5) == {1: (1, 3), 2: (1, 3), 3: (1, 3)}
    lines = ["a valve", "the quay", "a shaft"]
    assert [e["line"] for e in inspection.realigned(lines, [edit(2, "valve", "x"), edit(3, "quay", "y")])] == [1, 2] and inspection.realigned(lines, [edit(1, "valve", "x")])[0]["line"] == 1
    assert inspection.values_kept("| a | b |", "| b | a |") and not inspection.values_kept("| a | b |", "| b | c |")
    assert inspection.accepted("a\u200b  \n| x | y |\n|---|---|\n| 1 |\n| 1 | 2 |", {0, 3}) == ("a\n| x | y |\n|---|---|\n| 1 |\n| 1 | 2 |", [3])


def test_engines(spark):
    rows = [("p/a.md", "a.md", "md", b"x\r\ny"), ("p/b.pdf", "b.pdf", "pdf", b"%PDF"), ("p/c.pdf", "c.pdf", "pdf", b""), ("p/d.djvu", "d.djvu", "djvu", b"AT")]
    queue = spark.createDataFrame(rows, "path string, name string, kind string, content binary")

    def call(content, name):
        if not content:
            raise ValueError(name)
        return name.upper(), 2

    registry = engines.Registry(engines.Texts())
    registry.register(engines.Called("reader", ("pdf", "md"), call))
    assert registry.of("pdf").name == "reader" and registry.of("md").name == "texts" and registry.of("djvu") is None
    assert {tuple(r) for r in registry.convert(queue).collect()} == {("p/a.md", "x\ny", 1, "texts"), ("p/b.pdf", "B.PDF", 2, "reader"), ("p/c.pdf", None, None, "reader"), ("p/d.djvu", None, None, None)}


def test_hyphens_of_blocks(spark):
    from pyspark.sql import functions as F

    from quire.functions import columns as K

    assert spark.createDataFrame([("the va-\nlve of soft\u00adware",)], "t string").select(K.hyphens_joined(F.col("t")).alias("t")).collect()[0].t == "the valve of software"
