import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm import entry, leakage, lookalikes, markup, packing, personal, quality, repetition, scans, splitting

LONG = "A value of 12 bar agrees with the long measured pressure. " * 4000
BODY = "field_name string, rec_id bigint, text string, kind string, markup string, n bigint, word string"
TABLES = {
    "ocr_results": "result_id bigint, archive_id string, lang string, body string, pages int, field_name string, rec_id string, text string, kind string",
    "ocr_error_checks": "check_id bigint, result_id bigint, texts array<string>, labels array<string>, rec_id string, pos string, kind string, text string",
    "block_outputs": "block_key bigint, result_id bigint, page_id int, block_id int, block_type string, id string, html string, section_hierarchy map<int,string>, rec_id string, text string, word string, part string, piece string",
    "documents": "doc_id bigint, text string, lang string, kind string, item_id string, container_id string, piece string, value string",
    "eval_items": "item_id bigint, suite string, lang string, text string, doc_id string, share string",
    "size_limits": "limit_name string, max_size int, overlap_size int, unit string, text string",
    "common_words": "lang string, word string, word_rank int, text string",
}


def save(spark, folder, **rows):
    for name, schema in TABLES.items():
        width = len(schema.replace("map<int,string>", "m").split(", "))
        data = [tuple(r) + (None,) * (width - len(r)) for r in rows.get(name, [])]
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


LIMITS = [("body", 300, 20, "characters"), ("section", 60, 10, "characters"), ("container", 64, 0, "tokens"), (None, None, None, None)]
WORDS = [("en", "the", 1), ("en", "of", 2), (None, None, None)]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return save(spark, tmp_path_factory.mktemp("empty"), size_limits=LIMITS, common_words=WORDS)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    texts = [None, "", " ", "\n\n", "x", "[page 1 not recognized]", LONG, "**" * 3000, "\x00\ud7ff𝔘", "Mail a.b@c.example or call +1 (202) 555-0137."]
    results = [(i, None, None, t, None) for i, t in enumerate(texts)]
    checks = [(0, 0, None, None), (1, 1, [], None), (2, 2, [None, "", LONG], ["bad"]), (3, 3, ["x"] * 5, None), (None, None, ["a"], None)]
    blocks = [(i, 1, 0, i, "Text", f"/page/0/Text/{i}", t, {1: "/page/0/SectionHeader/0"}) for i, t in enumerate(texts)] + [(90, None, None, None, None, None, None, None), (91, 1, None, None, None, None, "<p>x</p>", {}), (None, 1, 0, 0, "Text", None, "<p>y</p>", {1: None})]
    docs = [(i, t, None) for i, t in enumerate(texts)] + [(None, "no id", None)]
    items = [(0, None, None, None), (1, None, None, ""), (2, None, None, "one two"), (3, "s", "en", LONG[:400]), (None, None, None, "x")]
    twice = lambda rows: rows + rows
    return save(spark, tmp_path_factory.mktemp("odd"), ocr_results=twice(results), ocr_error_checks=twice(checks), block_outputs=twice(blocks), documents=docs, eval_items=twice(items), size_limits=LIMITS, common_words=WORDS)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_empty_tables(spark, empty, name):
    assert entry.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_odd_rows(spark, odd, name):
    df = entry.queries()[name](spark, odd)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
        assert all(v is not None for r in rows for v in r)


def body(spark, *texts):
    return spark.createDataFrame([("body", i, t, "k", "m", 1, "w") for i, t in enumerate(texts)], BODY)


SENTENCES = ["The upper valve was closed before noon.", "Nobody measured the second shaft again.", "A drawing of the old quay hangs in the hall.", "Three men carried the gauge to the river.", "Its readings differ from the ledger by little."]


def brute_share(text):
    words = [w for w in re.findall(r"[^\W\d_]+", text.casefold())]
    covered, seen = set(), set()
    for i in range(len(words) - 3):
        g = tuple(words[i : i + 4])
        if g in seen:
            covered.update(range(i, i + 4))
        seen.add(g)
    return len(covered) / len(words)


def test_share_of_every_record(spark):
    one = "the upper valve leaks north of pier two the upper valve leaks"
    two = " ".join(SENTENCES) + " " + SENTENCES[0]
    mixed = "Latin words " * 250 + "и много русских слов подряд " * 400
    got = {r.rec_id: r for r in repetition.repetition(body(spark, one, two, mixed, "no word again")).collect()}
    assert [round(got[i].repeated_share, 6) for i in (0, 1, 3)] == [round(brute_share(x), 6) for x in (one, two, "no word again")]
    assert got[0].repeated_share > 0.3 and got[1].repeated_share > 0.1 and got[2].script == "cyrillic"


def test_repetition(spark):
    once = " ".join(SENTENCES)
    texts = [once, once + "\n" + once.upper() + "\n" + once, "\n".join(f"{k} - {SENTENCES[0]}" for k in range(9)), "| 1 | 2 | 3 |\n" * 20, SENTENCES[0]]
    out = {r.rec_id: r for r in repetition.repetition(body(spark, *texts)).collect()}
    for i in (0, 1, 4):
        assert out[i].repeated_share == pytest.approx(brute_share(texts[i]))
    assert out[2].repeated_share > 0.8 and out[1].band == "repeats" and out.get(3) is None or out[3].repeated_share == 0
    assert [r.rec_id for r in repetition.repetition(body(spark, *texts), False).orderBy("rec_id").collect()] == [1, 2]
    assert out[0].chars_per_token > 2 and out[0].token_entropy > 3


def test_bands_decide(spark):
    """Junk that repeats itself has the share of a case, and only its characters per token tell it from one."""
    junk = "q9#x7 zv_k !w~p4 xq|z vv#t k9~ zx" + "\n"
    greek = "η βαλβίδα έκλεισε πριν από το μεσημέρι και κανείς δεν μέτρησε\n"
    rows = {r.rec_id: r for r in repetition.repetition(body(spark, junk * 9, (SENTENCES[0] + "\n") * 9, greek * 9, " ".join(SENTENCES))).collect()}
    assert [rows[i].band for i in range(4)] == ["odd", "repeats", "repeats", "ordinary"] and rows[0].repeated_share > 0.8 and rows[2].script == "greek"
    assert {r.rec_id for r in repetition.repetition(body(spark, junk * 9, (SENTENCES[0] + "\n") * 9), False).collect()} == {1}
    assert {r.script for r in repetition.bands_of(repetition.repetition(body(spark, " ".join(SENTENCES)))).collect()} == {"latin"}


def test_no_case_is_rejected():
    random.seed(9)
    for _ in range(400):
        words = [random.choice("abcdefghijklmnopqrstuvwxyz") * random.randint(2, 4) for _ in range(random.randint(2, 12))] + ["0"]
        units = [random.choice(words) for _ in range(random.randint(4, 80))]
        lines = [0, *sorted(random.sample(range(1, len(units)), random.randint(0, 3))), len(units)]
        assert repetition.phrase_deficit(units, lines) + 1e-9 >= repetition.repeated_share(units, lines) / 2


def test_ratios_decide_doubts():
    """Half of the lines are prose; function words and sentence ends make the text prose, symbols and figures don't."""
    common = frozenset("the of and to by was from".split())
    prose = "The men carried the gauge to the river and the valve of the shaft was closed.\n"
    listed = "- the upper valve of the second shaft, closed by the men\n- the old gauge, carried to the river\n"
    figures = "- 88,5 bar / 12,4 mm / 7 % + 3,2\n- 41,8 bar / 90,1 mm / 8 % + 1,7\n- 17,5 bar / 33 %\n"
    assert quality.judged(prose + listed, common)[0] == "prose" and quality.judged(prose + listed, frozenset())[11] < 0.5
    assert quality.judged(prose + figures, frozenset())[0] == "table"


def test_labels(spark, tmp_path):
    folder = save(spark, tmp_path, ocr_error_checks=[(1, 1, [" ".join(SENTENCES), "m i r c n f o v j z x s v w r b h z", "x y z"], ["bad", "bad"])], common_words=WORDS)
    got = {(r.rec_id, r.pos, r.kind, r.label, r.agrees) for r in quality.labels(spark, folder).collect()}
    assert {(1, 0, "prose", "bad", False), (1, 1, "junk", "bad", True)} <= got and len(got) == 3


LONG_ITEM = "removal of the worn upper valve and the gauge beside it before"


@pytest.mark.parametrize(
    "text, kind",
    [
        ("\n".join("  " * (k % 3) + f"{LONG_ITEM} {w}" for k, w in enumerate(["noon", "the next storm came", "dusk", "a winter", "the river rose again", "it"])), "list"),
        ("\n".join(LONG_ITEM + (" the long survey of the second quay" if k % 2 else " it") for k in range(10)), "list"),
        ("valve 12 3,5 7\ngauge 4 18,5 9\nshaft 33 2,5 1\nquay 8 41 22", "table"),
        ("Valve, 12, 14, 17\nOld shaft, 140, 150, 160\nThe quay, 7, 9, 10\nGauge, 33, 38, 40", "list"),
        ("\n".join("  " * (k % 3) + s for k, s in enumerate(SENTENCES)), "prose"),
        ("the men who carried the old gauge to the river came back before the\nstorm had passed over the second shaft and the upper valve was then\nclosed by hand so that nobody had to measure the quay again while the\nledger of the year hung in the hall beside a drawing of the old pump", "prose"),
    ],
)
def test_kind_by_layout(text, kind):
    assert quality.judged(text, frozenset(["the"]), False)[0] == kind


@pytest.mark.parametrize(
    "text, kind",
    [
        (" ".join(SENTENCES), "prose"),
        ("\n".join(f"{k}. {s}" for k, s in enumerate(SENTENCES)), "prose"),
        ("- upper valve\n- second shaft\n* old quay (12)\n  - gauge", "list"),
        ("Valve ........ 3\nShaft ....... 17\nQuay ............ 40", "list"),
        ("Valve, 12\nOld shaft, 140\nThe quay, 7\nGauge, 33", "list"),
        ("| a | 1 | 2 |\n| b | 3 | 4 |\n| c | 5 | 6 |", "table"),
        ("a\t1\t2\nb\t3\t4\nc\t5\t6", "table"),
        ("1;2,5;3\n2;4;5,1\n3;–;8", "table"),
        ("xkcd wqrt bvnm\nzzxq|~^ _-~ ^^|;~\n|~^_ :;.~ ^^-_", "junk"),
        ("m i r c n f o v j z x s v w r b h z", "junk"),
        ("[page 2 not recognized]", "empty"),
        ("", "empty"),
    ],
)
def test_quality(text, kind):
    assert quality.judged(text, frozenset({"the"}))[0] == kind


@pytest.mark.parametrize(
    "field, text, kinds",
    [
        ("body", "A <b>valve</b> was closed<br/> early.", {"html"}),
        ("body", "Of '''old valves''' and [[Quay|the quay]].\n\n== The Shaft ==\n", {"wiki"}),
        ("body", "An \\emph{old valve} and \\cite{src1} here.", {"latex"}),
        ("body", "# Own\n\n**bold** `<b>` $a \\le b$ and n < 3 > 2, C:\\scans\\vol31.tif\n\n```\n<p>[[x]]</p>\n```\n<!-- source:page 3 -->", set()),
        ("body", "#\\~^}\\}}?$[|:|]>}*]~}:{~[=~@%!=;@?;;^~}\\#;{:/+[;>_!|", set()),
        ("html", "<p block-type='Text'>An **old valve** was closed.</p>", {"markdown"}),
        ("html", "<p>The valve&lt;sup&gt;35&lt;/sup&gt; was closed.</p>", {"html"}),
        ("html", "<p>Here n &lt; 38 and p &gt; 41. Bolts &amp; nuts.</p><pre>&lt;b&gt; [[draft]]</pre><math>x_{1} \\le 2</math>", set()),
        ("html", "<p>— 12 —</p>", set()),
    ],
)
def test_markup(field, text, kinds):
    assert {k for _, _, k, _ in markup.marks(field, 1, text)} == kinds


def clean(field, text):
    return list(markup.cleaned(field, 1, text))[0][3]


@pytest.mark.parametrize(
    "text, want",
    [
        ("<h2>The <b>Shaft</b></h2>\n<ul><li>one</li><li>two</li></ul>\n`<b>` and $a<b$", "## The Shaft\n- one\n- two\n`<b>` and $a<b$"),
        ("Open C:\\section\\part\\item7 now. An \\emph{old \\textbf{worn} valve}~\\cite{a1} here.", "Open C:\\section\\part\\item7 now. An old worn valve here."),
        ("Here n < 3 > 2 and a <b>valve</b>.\n\n```\n<b>x</b>\n\n\n\ny\n```\n", "Here n < 3 > 2 and a valve.\n\n```\n<b>x</b>\n\n\n\ny\n```\n"),
        ("Of '''old valves''' and [[Quay|the quay]]. {{note|x}}\n\n== The Shaft ==\n\n\n\nend", "Of old valves and the quay. \n\n## The Shaft\n\n\n\nend"),
        ("{\\it An old} valve. \\section{The Shaft}\nIts \\href{http://a.example}{drawing} hangs.", "An old valve. \n## The Shaft\nIts drawing hangs."),
        ("nothing here", "nothing here"),
    ],
)
def test_markup_clean(text, want):
    assert clean("body", text) == want


def test_markup_clean_of_blocks():
    assert clean("html", "<h2>The Shaft</h2><ul><li>one</li><li>two &lt;b&gt;x&lt;/b&gt;</li></ul><pre>a\n  b</pre><p>Sum <math>x_1</math>, n &lt; 3.</p>") == "## The Shaft\n- one\n- two x\n\n```\na\n  b\n```\n\nSum $x_1$, n < 3."
    assert clean("html", "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>") == "| a | b |\n| --- | --- |\n| 1 | 2 |"


@pytest.mark.parametrize("size", [10, 300, 3000])
def test_long_marks(size):
    inner = " ".join(["valve and gauge"] * (size // 15 + 1))
    kinds = lambda field, text: {k for _, _, k, _ in markup.marks(field, 1, text)}
    assert kinds("body", f"The old quay. <!-- {inner} --> It stands.") == {"html"}
    assert kinds("body", f"The old quay. '''{inner}''' stands.") == {"wiki"}
    assert kinds("html", f"<p>The old quay. **{inner}** stands.</p>") == {"markdown"}
    assert kinds("body", f"The old quay, ${inner} \\emph{{x}}$ stands.") == set()


def test_edges_decide():
    """What is near decides weak marks; without the edges they stay in the text, or content is taken for residue."""
    text = "An <b>old</b> valve <stamp>was</stamp> closed.\n\n\nFar away " + "the men walked home " * 60 + "and <stamp> is all."
    kept = lambda tied: {text[a:b] for a, b, _ in markup.residue("body", text, tied)}
    assert kept(True) == {"<b>", "</b>", "<stamp>", "</stamp>"} and kept(False) == {"<b>", "</b>"}
    assert [text[a:b] for a, b, _ in markup.residue("body", text)].count("<stamp>") == 1
    latex = "The \\emph{old} \\foo valve was closed."
    assert [latex[a:b] for a, b, _ in markup.residue("body", latex)] == ["\\emph{old}", "\\foo"]
    assert [latex[a:b] for a, b, _ in markup.residue("body", latex, False)] == ["\\emph{old}"]


def test_min_cut_is_least():
    random.seed(1)
    for _ in range(40):
        n = random.randint(1, 6)
        source, sink = [random.random() for _ in range(n)], [random.random() for _ in range(n)]
        ties = {(a, b): random.random() for a in range(n) for b in range(a)}
        flow = markup.Flow(n + 2)
        for i in range(n):
            flow.add(n, i, source[i])
            flow.add(i, n + 1, sink[i])
        for (a, b), c in ties.items():
            flow.add(a, b, c, c)
        cost = lambda side: sum(sink[i] if side[i] else source[i] for i in range(n)) + sum(c for (a, b), c in ties.items() if side[a] != side[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(flow.cut(n, n + 1)[:n]) == pytest.approx(best)


def test_lookalikes(spark):
    plain = "The valve was reached by noon. " * 3 + "ice "
    texts = [plain, "The vаlve was closed", "The ｖａｌｖｅ was", "Noon­ was", "a\u00a0valve", "Δ m² 1½ № … PDF-файл", "an ісе day", "Кран и насос стоят. Кран и насос стоят.", "нacoс стоят кран"]
    got = lookalikes.lookalikes([("body", body(spark, *texts))]).collect()
    by = {}
    for r in got:
        by.setdefault(r.rec_id, {})[r.token] = r.canonical
    assert set(by) == {1, 2, 3, 4, 6, 8}
    assert by[1] == {"vаlve": "valve"} and by[2] == {"ｖａｌｖｅ": "valve"} and by[4] == {"\u00a0": " "} and by[8] == {"нacoс": "насос"}


def test_walk_weighs_edits():
    trie = lookalikes.Trie([("valve", 9), ("valves", 3), ("café", 4), ("измерения", 5)])
    assert trie.walk("v\u0430l\u00advе", 0.5) == [(0.0, -9, "valve")] and trie.walk("ＶＡＬＶＥ", 0.5)[0][2] == "valve"
    assert trie.walk("cafe", 0.5) == [(0.5, -4, "café")] and trie.walk("cafe\u0301", 0.5) == [(0.0, -4, "café")]
    assert [w for _, _, w in trie.walk("valv", 1.0)] == ["valve"] and trie.walk("valv", 0.5) == []
    back = lookalikes.Trie([("измерения", 5)], True)
    assert back.walk("измepeниe", 1.0) == [(1.0, -5, "измерения")]
    # one letter off a Russian word: its look-alikes are read as Cyrillic although most letters of the token are Latin
    token = "koнtpacтe"
    own = {"контраста": 5}
    assert lookalikes.canonical(token, "latin", lookalikes.Trie(list(own.items())), own)[0] == "контрасте"
    assert lookalikes.canonical(token, "latin", lookalikes.Trie([]), {})[0] != "контрасте"
    assert lookalikes.canonical(token, "latin", lookalikes.Trie(list(own.items())), own, budget=0.5)[0] != "контрасте"


def test_every_word_within_the_budget(spark):
    latin = str.maketrans("котрасе", "kotpace")
    known = ["контраст", "контраста", "контрастам", "контрастера", "тест", "straße", "both", "valve", "note"]
    words = spark.createDataFrame([(w, 5) for w in known], "word string, n bigint")
    # one letter off at any place, most letters Latin ones: the word tells that they are Cyrillic
    want = {}
    for word in known[:4]:
        for i in range(len(word)):
            off = word[:i] + ("к" if word[i] != "к" else "о") + word[i + 1 :]
            want[off.translate(latin) if i != 2 else off[0] + off[1:].translate(latin)] = off
    # short words, sharp s, Greek capitals and tokens of several words
    want |= {"тecтa": "теста", "Str\u0430ße": "Straße", "Βοth": "Both", "cafe\u200b\u0301": "café", "v\u0430lve\u2011тecтa.": "valve-теста.", "a\u00adnd/кот": "and/кот"}
    got = {r.token: r for r in lookalikes.spellings(spark.createDataFrame([(t, "latin") for t in want], "token string, script string"), words).collect()}
    assert {t: got[t].canonical for t in want} == want
    assert all(got[t].matched for t in ("Str\u0430ße", "Βοth")) and not got["тecтa"].matched
    # a correct short word of another script is a letter off some word
    assert lookalikes.canonical("кот", "latin", lookalikes.Trie([("not", 9)]), {"not": 9})[:3] == ("кот", False, False)
    assert {tuple(r[2:]) for r in lookalikes.unusual("body", 1, "the v\u0430lve\u2011box, a PDF\u2011box") } == {("v\u0430lve\u2011box,", "latin", None), ("PDF\u2011box", "latin", "PDF-box")}


def test_one_form(spark):
    plain = "The valve was near the café, and the upper valve was closed (again)."
    other = "The v\u0430lve was near\u00a0the cafe\u0301, and the upper ｖａｌｖｅ was clo\u00adsed (ag\u0430in)."
    bodies = body(spark, plain, other, *[plain] * 3)
    blocks = bodies.select(F.lit("html").alias("field_name"), "rec_id", F.concat(F.lit("<p class='v\u0430lve'>1 &lt; 2, &#1072;gain <b>"), F.regexp_replace("text", "\u00a0", "&nbsp;"), F.lit("</b></p>")).alias("text"))
    got = {(r.field_name, r.rec_id): r.clean for r in lookalikes.normalized([("body", bodies), ("html", blocks)]).collect()}
    assert len(got) == 10 and {v for (f, _), v in got.items() if f == "body"} == {plain}
    assert {v for (f, _), v in got.items() if f == "html"} == {f"<p class='v\u0430lve'>1 &lt; 2, again <b>{plain}</b></p>"}


def test_scans(spark):
    prose = "The valve was closed before noon and the gauge was read again by hand.\nNobody measured the second shaft after the storm had passed over it.\n"
    pages = [f"Old quay of the river | {40 + k}\nPage of {w} text\nand the {w} gauge goes on\nto its end." for k, w in enumerate(["upper", "second", "storm", "shaft"])]
    bodies = body(spark, "The inlet-\nand outlet valve. The va-\nlve was closed.", "The va1ve and the gaugc were read.", prose * 8, "plain gauge text")
    checks = spark.createDataFrame([("texts", 9, pages)], "field_name string, rec_id bigint, texts array<string>")
    blocks = spark.createDataFrame([(k, 5, k, 0, "Text", f"<p>Upper shaft report</p>") for k in range(3)] + [(k + 10, 5, k, 9, "Text", f"<p>— {k + 7} —</p>") for k in range(3)] + [(30, 6, 0, 0, "PageHeader", "<p>Upper shaft report</p>")], "block_key bigint, result_id bigint, page_id int, block_id int, block_type string, html string")
    bodies = bodies.select("field_name", "rec_id", "text")
    more = body(spark, *[prose] * 9).select("field_name", (F.col("rec_id") + 100).alias("rec_id"), "text")
    got = {(r.field_name, r.rec_id, r.kind) for r in scans.noise(bodies.unionByName(more), checks, blocks).collect()}
    assert got == {("body", 0, "hyphen"), ("body", 1, "misread"), ("texts", 9, "header"), ("texts", 9, "pageno")} | {("html", k, "header") for k in range(3)} | {("html", k + 10, "pageno") for k in range(3)}


def test_broken_and_misread(spark):
    prose = "The valve was closed before noon and the third delivery came late. Третьей очереди нет.\n"
    bodies = body(spark, "The del-\nivcry came.", "The de1i-\nvery came.", "Третьеи очереди.", "The valve closcd.", *[prose * 3] * 9).select("field_name", "rec_id", "text")
    none = spark.createDataFrame([], "field_name string, rec_id bigint, texts array<string>")
    blocks = spark.createDataFrame([], "block_key bigint, result_id bigint, page_id int, block_id int, block_type string, html string")
    rows = scans.noise(bodies, none, blocks).where("rec_id < 4").collect()
    assert {(r.rec_id, r.kind) for r in rows} == {(0, "hyphen"), (0, "misread"), (1, "misread"), (2, "misread"), (3, "misread")}
    assert {r.printed for r in rows if r.kind == "misread"} == {"delivery", "третьей", "closed"}


def test_header_of_short_pages():
    leads = ["Upper", "Second", "Old", "Worn", "Late", "Dry", "Cold", "Last"]
    pages = "\n\n".join(f"Ledger of the old quay\n\n{w} valves were closed before noon." for w in leads)
    lines, found, paged = scans.body_lines(pages)
    headers, _ = scans.edges(found, paged)
    assert {lines[i] for i in headers} == {"Ledger of the old quay"} and len(headers) == 8
    lines, found, paged = scans.body_lines("\n\n".join(["Ledger of the old quay", "The valves were closed before noon."] * 8))
    assert scans.edges(found, paged)[0] == set()


def test_long_header_and_far_lines():
    long = "Ledger of the old quay and of all of its valves, gauges, shafts and pumps as they were measured by hand in the winter before the storm " + "came over the river"
    for head in (long, long[:100]):
        pages = [f"{head}\n{w} men closed the valve\nand went home." for w in ("Two", "Six", "Ten")]
        lines, found = scans.text_lines(pages)
        assert {i for i in scans.edges(found, True)[0]} == {0, 3, 6}
    pages = ["\n".join(["x y"] * 120_000) + f"\n{k}" for k in range(4, 7)]
    assert scans.edges(scans.text_lines(pages)[1], True)[1] == {120_000, 240_001, 360_002}


def test_readings_beyond_the_bounds(spark):
    words = ["inconceivabilities", "counterrevolutionaries", "x" * 45 + "valve"]
    many = ["1nc0nce1vab1l1t1e5", "c0unterrev01ut10nar1es", "x" * 45 + "va1ve", "1nc0nce1vab1l1t1ex"]
    assert scans.readings(many[0]) is None and "valve" in scans.readings("va1ve")
    assert [scans.reads_as(a, b) for a, b in zip(many, words)] == [True] * 3 and not scans.reads_as(many[3], words[0])
    for word in ("rnodern", "va1ve", "clog", "gaugc", "iinit"):
        assert all(scans.reads_as(word, r) for r in scans.readings(word))
    assert all(scans.shape(a) == scans.shape(b) for a, b in zip(many, words))
    there = spark.createDataFrame([(w, 100) for w in words], "word string, n bigint")
    got = scans.misreadings(spark.createDataFrame([(w, 1) for w in many], "word string, n bigint"), there).collect()
    assert {(r.word, r.printed) for r in got} == set(zip(many, words))


def test_scans_read_a_text_once(spark, monkeypatch):
    # tags of a block are read once, not again in each filter
    blocks = spark.createDataFrame([(1, 5, 0, 0, "Text", "<p>Upper shaft</p>")], "block_key bigint, result_id bigint, page_id int, block_id int, block_type string, html string")
    assert scans.block_edges(blocks)._jdf.queryExecution().optimizedPlan().toString().count("content-ref") == 1
    # only lines with a word to look up are searched for junk
    kernels, graded = [], []
    monkeypatch.setattr(C, "arrow_rows", lambda df, kernel, *rest: kernels.append((kernel, rest[-1])))
    monkeypatch.setattr(C, "narrow", lambda df: df)
    monkeypatch.setattr(scans, "junk_share", lambda line, share=scans.junk_share: graded.append(line) or share(line))
    known = spark.sparkContext.broadcast(frozenset("the valve was closed".split()))
    scans.candidates(None, "body", known)
    run, setup = kernels[0]
    text = "The valve was closed ^^.\n" * 50 + "The va1ve was\u200b read.\nThe gau- \nge\n¤¬¦ gaugc ¤¬¦ %%% ¤¬¦ ¬¬¬\n"
    rows = set(run("body", 1, text, *setup()))
    assert {(r[2], r[3], r[5]) for r in rows} == {("misread", "read", None), ("misread", "gau", None), ("hyphen", "gauge", None), ("misread", "gauge", 1), ("misread", "va1ve", 1)}
    assert len(graded) <= 5


def test_scan_repair():
    pages = [f"Old quay | {k}\nLine {chr(97 + k) * 3} goes on\nto the end of {chr(97 + k) * 4} va-\nlves here." for k in range(3)]
    text = scans.repaired("texts", pages, {"thc": "the"}, {"valves"})
    assert "Old quay" not in text and "valves here." in text and "goes on to the" in text


def test_scan_repair_keeps_code_and_formulas():
    fence = "```sql\nselect va-\nlves\n\n\n\nfrom thc\n```"
    text = f"# Upper shaft\nThe sum $a_1 + b$ of thc\nva-\nlves and `thc va1ve` is\n$c$ for all.\n{fence}\nThe va\u200b1ve\ngoes on.\n\n$$\nx\n= thc\n$$\n\na | b\nc | d\n"
    clean = scans.repaired("body", text, {"thc": "the", "va1ve": "valve"}, {"valves"})
    assert clean == f"# Upper shaft\nThe sum $a_1 + b$ of the valves and `thc va1ve` is $c$ for all.\n{fence}\nThe valve goes on.\n\n$$\nx\n= thc\n$$\n\na | b\nc | d"
    cut = "The second shaft was\n\n<!-- source:page 2 -->\n\nmeasured by hand."
    assert scans.repaired("body", cut, {}, set()) == "The second shaft was measured by hand."


def test_scan_repair_of_html():
    fix = lambda x: scans.repaired("html", x, {"thc": "the", "va1ve": "valve"}, {"valves"})
    assert fix("<p>A <b>va1ve</b> of thc&nbsp;quay, <i>va-</i><br/>\nlves &lt; 3<br/>and more.</p>") == "<p>A <b>valve</b> of the&nbsp;quay, <i>va</i>lves &lt; 3 and more.</p>"
    assert fix('<p title="thc">Some va-</p>\n<p>lves and <code>thc</code></p><pre>thc\nva-\nlves</pre>') == '<p title="thc">Some valves and <code>thc</code></p><pre>thc\nva-\nlves</pre>'
    assert fix("<ul><li>Some va-</li></ul><p>lves here</p>") == "<ul><li>Some valves</li></ul><p> here</p>"
    assert fix("<p>thc<br/><br/>end</p>") == "<p>the<br/><br/>end</p>"


def test_every_record_is_repaired(spark, tmp_path):
    prose = "The valve was closed before noon\nand the gauge was read again."
    blocks = [(k, 5, k, 0, "Text", None, "<p>Upper shaft report</p>") for k in range(3)] + [(9, 5, 0, 1, "Text", None, "<p>The gauge was read<br/>\nby hand.</p>"), (10, 5, 1, 1, "Text", None, "<p>plain</p>")]
    folder = save(spark, tmp_path, ocr_results=[(1, None, None, prose), (2, None, None, "plain")], ocr_error_checks=[(3, 1, ["The gauge was\nread.", None])], block_outputs=blocks + blocks)
    got = [tuple(r) for r in scans.repair(spark, folder).collect()]
    clean = {("body", 1, prose.replace("\n", " ")), ("body", 2, "plain"), ("texts", 3, "The gauge was read."), ("html", 9, "<p>The gauge was read by hand.</p>"), ("html", 10, "<p>plain</p>")}
    assert len(got) == 8 and set(got) == clean | {("html", k, "") for k in range(3)}


@pytest.mark.parametrize("kind", ["text", "html"])
def test_splitting(kind):
    random.seed(2)
    for _ in range(60):
        text = "".join(random.choice(["word ", "end. ", "\n", "\n\n# H\n", "<p>x</p>", "ж"]) for _ in range(random.randint(0, 400)))
        limit, overlap = random.randint(5, 300), random.randint(0, 4)
        s = splitting.spans(text, limit, overlap, kind)
        assert "".join(text[a:b] for a, b in s) == text
        assert all(b > a for a, b in s) and all(min(b - a + (overlap if k else 0), len(text)) <= limit for k, (a, b) in enumerate(s))
        assert (len(s) > 1) == (len(text) > limit)


def test_pieces(spark, tmp_path):
    folder = save(spark, tmp_path, ocr_results=[(1, None, None, SENTENCES[0] * 20), (2, None, None, "short")], block_outputs=[(k, 1, 0, k, "Text", "i", "<p>" + "x" * 20 + "</p>", {1: "a", 2: "b"}) for k in range(4)] + [(9, 1, 0, 9, "Text", "i", None, {1: "c"})], size_limits=LIMITS)
    rows = splitting.pieces(spark, folder).orderBy("item_kind", "result_id", "section_id", "piece").collect()
    limit = {"body": 300, "section": 60}
    assert all(len(r.text) <= limit[r.item_kind] for r in rows)
    for key, whole in {("body", 1, ""): SENTENCES[0] * 20, ("section", 1, "b"): ("<p>" + "x" * 20 + "</p>") * 4}.items():
        own = [r for r in rows if (r.item_kind, r.result_id, r.section_id) == key]
        assert "".join(r.text[r.n_overlap :] for r in own) == whole
        assert all(b.text[: b.n_overlap] == a.text[len(a.text) - b.n_overlap :] or len(a.text[a.n_overlap :]) < b.n_overlap for a, b in zip(own, own[1:]))
    assert {tuple(r) for r in splitting.found(spark, folder).collect()} == {("body", 1, ""), ("section", 1, "b")}


def test_big_section(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(splitting, "BIG", 100)
    blocks = [(k, 1, k // 5, k, "Text", "i", "<p>" + chr(97 + k) * 30 + "</p>", {1: "a"}) for k in range(20)]
    folder = save(spark, tmp_path, block_outputs=blocks, size_limits=LIMITS)
    rows = splitting.pieces(spark, folder).orderBy("piece").collect()
    assert "".join(r.text[r.n_overlap :] for r in rows) == "".join(b[6] for b in blocks) and max(len(r.text) for r in rows) <= 60


def test_packing(spark):
    random.seed(3)
    docs = [(i, " ".join(random.choice(["valve", "gauge", "Schacht", "река", "a"]) for _ in range(random.randint(1, 90)))) for i in range(300)] + [(900, "word " * 500), (901, "ы" * 400), (902, ""), (903, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("piece", F.lit("x"))
    rows = packing.packed(df, 64).collect()
    sizes = packing.Sizes()
    fill, text = {}, dict(docs)
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert len(sizes.encoding.encode_ordinary(text[r.doc_id][r.start_char : r.end_char])) == r.n_tokens
    assert max(fill.values()) <= 64
    for i, t in docs:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert "".join(t[r.start_char : r.end_char] for r in own) == (t or "")
        if t and len(sizes.encoding.encode_ordinary(t)) <= 64:
            assert len(own) == 1
    assert len(fill) <= 1.05 * sum(fill.values()) / 64 + 1
    groups = {}
    for r in rows:
        groups[r.step_group] = groups.get(r.step_group, 0) + r.n_tokens
    assert max(groups.values()) - min(groups.values()) <= 2 * 64


def test_pack_ties():
    where, fill, of = packing.pack([5, 5, 5, 5], 10)
    assert fill == [10, 10] and sorted(where) == [0, 0, 1, 1] and of == [1, 1]
    assert packing.pack([], 10) == ([], [], [])


def test_tiers_save_windows():
    random.seed(8)
    for _ in range(20):
        sizes = [random.choice([random.randint(1, 30), random.randint(40, 100)]) for _ in range(400)]
        where, fill, of = packing.pack(sizes, 100)
        assert max(fill) <= 100 and sum(fill) == sum(sizes) and all(fill[w] == sum(s for s, x in zip(sizes, where) if x == w) for w in range(len(fill)))
        assert len(fill) < len(packing.pack(sizes, 100, False)[1])
        assert of == sorted(of) and {packing.tier_of(s, 100) for s in sizes} <= set(range(packing.TIERS))


def test_leakage(spark):
    random.seed(4)
    vocabulary = [a + b for a in ("val", "gau", "sha", "riv", "qua", "led", "dra", "pum") for b in ("ve", "ge", "ft", "er", "y", "ing", "on", "met")]
    passage = lambda n: [random.choice(vocabulary) for _ in range(n)]
    intro = "Read the following passage with care and answer the question below."
    texts = [passage(60) for _ in range(8)]
    items = [(i, f"{intro}\n\n{' '.join(t)}." if i % 2 else " ".join(t)) for i, t in enumerate(texts)]
    filler = lambda: " ".join(passage(80))
    docs, want = [], set()
    for i, t in enumerate(texts):
        altered = [w[:-1] + "x" if k % 9 == 4 else w for k, w in enumerate(t)]
        kinds = [(t, True), (t[:36], True), (t[:20] + passage(60) + t[35:55], True), ([w.upper() for w in altered], True), (t[:10], False), (intro.split(), False), ([], False)]
        for k, (part, is_leak) in enumerate(kinds):
            docs.append((i * 10 + k, f"{filler()}. {'  '.join(part)}\n{filler()}"))
            if is_leak:
                want.add((i, i * 10 + k))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("x"))
    got = {(r.item_id, r.doc_id) for r in leakage.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == want


def test_leaks_do_not_depend_on_neighbours(spark):
    """Shared instructions are found over the whole table; short passages are asked for as a whole; frequent terms are skipped."""
    random.seed(5)
    some = lambda n: " ".join(random.choice("abcdefghij") * 2 + random.choice("klmnopqrst") + str(random.randint(0, 9)) for _ in range(n))
    intro = "Read this passage with care"
    texts = [some(30) for _ in range(40)]
    short = ["upper valve gauge", "worn shaft of the old quay", "two words"]
    items = [(i, f"{intro}\n\n{t}") for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(short)]
    docs = [(i, f"{intro} {some(20)} {t.upper()} {some(20)}") for i, t in enumerate(texts)] + [(100, f"{some(9)} upper valve gauge {some(9)}"), (101, "worn shaft of the new quay"), (102, f"an upper, valve; two words {intro}")]
    df = spark.createDataFrame(docs * 2, "doc_id bigint, text string")
    got = leakage.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.item_id, r.doc_id) for r in got} == {(i, i) for i in range(40)} | {(100, 100)} and len(got) == 41
    assert {r.match for r in got} == {"phrase"}
    terms = spark.createDataFrame([(1, 30, k, k) for k in range(20)], "item_id bigint, n_words int, place int, term bigint")
    df = spark.createDataFrame([(k, 900 if k < 9 else 1) for k in range(19)], "term bigint, df bigint")
    assert {r.term for r in leakage.looked_up(terms, df, 1000).collect()} == {0, 1, 2, 3, 4} | set(range(9, 19))


def test_bit_table(spark):
    terms = [random.getrandbits(64) - (1 << 63) for _ in range(3000)]
    table = leakage.bit_table(spark.createDataFrame([(t,) for t in terms], "term bigint"))
    import numpy as np

    assert table.holds(np.array(terms, dtype=np.int64).view(np.uint64)).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.int64).view(np.uint64)
    assert table.holds(other).mean() < 0.001


def test_personal():
    cases = {
        "Write to a.b+c@mail.example.net or x7 [at] depot[dot]test now": ["EMAIL", "EMAIL"],
        "Call +1 (202) 555-0137, 01632 960109 or 030/23125588.": ["PHONE", "PHONE", "PHONE"],
        "Tel. 0049 30 23125 130 and Tél. 01.99.00.10.50, Тел. 8(000)6129249": ["PHONE"] * 3,
        "SSN 000-17-3123, passport no. X00547980, Steuer-ID 00 444 269 671, паспорт 00 00 603861": ["ID"] * 4,
        "She lives at 95 Marsh End Drive, Ambrow.": ["ADDRESS"],
        "Wohnhaft Färberweg 84, 00133 Niederquell.": ["ADDRESS"],
        "Domicile : 7 bis, rue des Écluses-Vieilles, 00762 Valmonde.": ["ADDRESS"],
        "Проживает: ул. Песчаный Вал, д. 94, кв. 76.": ["ADDRESS"],
        "The survey was signed by WEXCOMBE, Martin. Dr Helen B. Ardquist came.": ["NAME", "NAME"],
        "Составил: Соловатова Л. П.": ["NAME"],
        "Sheet TK 28-54-0431, 12@380 mm, scan_081276@2x.png, lot 638-238, 2016-02-11, § 55.6.3, B13-803 00 35, `@cached(ttl=31)`": [],
        "Halvern Works at Port Haverley sheet 53, Quarry Hill shaft 69, DN 390/395, 0x7297AF": [],
        "": [],
    }
    for text, kinds in cases.items():
        assert [k for _, _, k in personal.spans(text, personal.Literals())] == kinds, text


def test_feistel():
    f, g = personal.Feistel("a"), personal.Feistel("b")
    for n in (1, 2, 3, 4):
        all_of = [str(i).zfill(n) for i in range(10**n)] if n < 4 else [str(i).zfill(4) for i in range(0, 10**4, 7)]
        out = [f.value(x) for x in all_of]
        assert len(set(out)) == len(out) and all(len(x) == n and x.isdigit() for x in out)
        assert [f.value(x, back=True) for x in out] == all_of
    assert f.value("QQ 278320 C", True) != f.value("QQ 278320 C") and re.fullmatch(r"[A-Z]{2} \d{6} [A-Z]", f.value("QQ 278320 C"))
    assert f.value("12025550137") != g.value("12025550137")


def test_formats_are_kept():
    f = personal.Feistel("k")
    values = {"ID": ["123-45-6789", "QQ 27 83 20 C", "AB 12 34 56 C", "86 095 742 719", "112-233-445 95", "7707083893", "500100732259", "2 55 08 14 168 025 38", "X00547980", "000-17-3123"], "PHONE": ["+49 (30) 123-4567", "0049 30 23125 130", "030/23125588 ext. 12"], "DATE": ["03.02.1950", "1987-12-31", "29/02/2000"]}
    assert [bool(personal.valid(v)) for v in values["ID"]] == [True, False, True, True, True, True, True, True, False, False]
    form = lambda x: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", x)))
    for kind, some in values.items():
        for v in some:
            out = personal.pseudonym(kind, v, f)
            assert form(out) == form(personal.normal(kind, v)) and out != v, (v, out)
            assert personal.pseudonym(kind, out, f, True) == personal.normal(kind, v)
            assert kind != "ID" or personal.valid(out) == personal.valid(v)
            assert kind != "DATE" or personal.day_of(out)
    days = {personal.pseudonym("DATE", f"{d:02d}.{m:02d}.1950", f) for d in range(1, 29) for m in range(1, 13)}
    assert len(days) == 28 * 12
    assert personal.pseudonym("PHONE", "0049 30 23125", f) == personal.pseudonym("PHONE", "+49 30 23125", f)
    assert [k for _, _, k in personal.spans("Ms Tanaka, born 03.02.1950, came on 04.05.2012; Frau Weiß and Dr. Okafor too.", personal.Literals())] == ["NAME", "DATE", "NAME", "NAME"]


def test_given_names_are_learned(spark):
    cued = [(k, f"The survey was signed by Priya Raghunathan{'ab'[k % 2]}. Nothing else.") for k in range(4)] + [(k, f"Checked by: Upper Valve{'xy'[k % 2]} men.") for k in range(4, 8)]
    other = [(10, "Then Priya Okonkwo came."), (11, "The Upper Shaft is old."), (12, "An Upper Gallery is old."), (13, "Our Upper Basin."), (14, "Its Upper Chamber."), (15, "No Upper Deck.")]
    df = spark.createDataFrame(cued + other, "doc_id bigint, text string")
    assert {r["name"]: (r.cued, r.pairs) for r in personal.given_names(df).collect()} == {"Priya": (4, 5)}
    got = {r.doc_id: r.value for r in personal.personal_data(df, "k").where("kind = 'NAME' and doc_id >= 10").collect()}
    assert got == {10: "Priya Okonkwo"}
    assert personal.spans(other[0][1], personal.Literals()) == []


def test_no_key_no_way_back(spark):
    df = spark.createDataFrame([(1, "Call +1 (202) 555-0137, again +1 (202) 555-0137")], "doc_id bigint, text string")
    one, two = (personal.redacted(df).collect()[0].text for _ in range(2))
    assert one != two and len(set(re.findall(r"\[.*?\]", one))) == 1


def test_redacted(spark):
    docs = [(1, "Call +1 (202) 555-0137 now"), (2, "tel:+12025550137 again"), (3, None), (4, "nothing")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("kind", F.lit("k"))
    out = {r.doc_id: r for r in personal.redacted(df, "key").collect()}
    first, second = (re.search(r"\[PHONE:(.*)\]", out[i].text)[1] for i in (1, 2))
    assert re.fullmatch(r"\+\d \(\d{3}\) \d{3}-\d{4}", first) and re.fullmatch(r"\+\d{11}", second)
    assert re.sub(r"\D", "", first) == re.sub(r"\D", "", second) != "12025550137" and out[3].text is None and out[4].text == "nothing" and out[1].n_replaced == 1


def test_shared_folder(spark):
    assert C.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
