import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import columns as K
from quire.operators import cleaning, edits, layout, words
from quire.operators import lines as L
from quire.operators import tables as T
from quire.plans import catalog, grading
from quire.sources import tables as S

DATA = "/root/testdata/sf0.001"


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "result_id bigint, body string, pages int")


def zoned(spark, *texts):
    return L.zoned(bodies(spark, *texts))


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    return round(float(value), 6) if isinstance(value, (int, float, np.number)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in "ocr_results ocr_error_checks block_outputs structure_counts edit_replies archives result_headers events".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    mine = catalog.QUERIES[name](spark, DATA).toPandas()
    theirs = con.execute(catalog.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    rows = [sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str) for df in (mine, theirs)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    """What no SQL says has rules of its own in test_passes; here it has to give rows of whole tables."""
    rows = catalog.QUERIES[name](spark, DATA).collect()
    assert rows or name == "numbered_margins"
    assert len(rows) == len({str(r) for r in rows})


def test_zones(spark):
    out = zoned(spark, "a\n```\n# no\n```\n$$\nx\n$$\n<table>\n<tr>\n</table>\nz", None, "").collect()
    first = [r for r in out if r.result_id == 0]
    assert [r.line for r in sorted(first, key=lambda r: r.line_no) if r.protected] == ["```", "# no", "```", "<table>", "<tr>", "</table>"]
    assert [r.line for r in sorted(first, key=lambda r: r.line_no) if r.display] == ["$$", "x", "$$"]
    assert [r.line for r in out if r.result_id == 2] == [""]


def test_headings(spark):
    h = L.headings(zoned(spark, "# A\n## B\n#### C\n# D\n```\n# E\n```"))
    rows = {r.title: r for r in L.section_path(h).collect()}
    assert {t: r.level for t, r in rows.items()} == {"A": 1, "B": 2, "C": 4, "D": 1}
    assert rows["C"].parent == 1 and rows["B"].parent == 0 and rows["D"].parent is None


def test_repeats_and_runs(spark):
    z = zoned(spark, "x\nsame\nsame\nsame\ny", "p\n\nq\n\nq\n\nq\n\nr")
    assert [(r.result_id, r.line, r.copies) for r in L.repeated_runs(z).collect()] == [(0, "same", 3)]
    assert [(r.result_id, r.copies) for r in L.repeated_blocks(L.with_blocks(z)).collect()] == [(1, 3)]


def test_words(spark):
    z = zoned(spark, " ".join(["turbine"] * 20) + " turbme turbino `turbina`")
    assert [(r.word, r.neighbour) for r in words.near_words(words.word_counts(z)).collect()] == [("turbino", "turbine")]
    z = zoned(spark, "deep-water deepwater deepwater deepwater")
    assert [r.decision for r in words.compounds(z).collect()] == ["join"]


def test_tables(spark):
    z = zoned(spark, "| a | b |\n| --- | --- |\n| 1 |  |\n| 2 |  | 3 |\n\n| a | b |\n| --- | --- |\n| 4 |  |")
    rows = T.rows(z)
    assert {(r.width, r.body_rows, r.odd_rows) for r in T.shapes(rows).collect()} == {(2, 2, 1), (2, 1, 0)}
    assert [(r.line_no, r.previous_line) for r in T.split_tables(rows, z).collect()] == [(5, 3)]


def test_edits(spark):
    rows = [("a 1", "a 2"), ("a", "a"), ("x", None), ("| a |", "a"), ("## t", "# t"), ("teh", "the"), ("$a", "a")]
    df = spark.createDataFrame(rows, "old_text string, new_text string").select("old_text", "new_text", edits.reason().alias("r"))
    assert [r.r for r in df.collect()] == ["digits changed", "no change", "no text", "row shape changed", "heading mark changed", None, "formula signs changed"]
    got = edits.decoded(spark.createDataFrame([(1, '```json\n[{"page":1,"line":2,"old":"a","new":"b"},]\n```'), (2, "nothing")], "reply_id int, reply string")).collect()
    assert [(r.reply_id, r.line, r.new_text) for r in got] == [(1, 2, "b")]


def test_chunks(spark):
    pages = spark.createDataFrame([(1, p, t) for p, t in enumerate([300, 300, 300, 900, 10])], "result_id bigint, page int, tokens bigint")
    assert [r.chunk for r in edits.chunks(pages, 600).orderBy("page").collect()] == [0, 0, 1, 2, 3]


def test_grade(spark):
    good = "# Title\n\n" + "A sentence that is long enough to be read by anybody. " * 10
    g = {r.result_id: r for r in grading.grade(bodies(spark, good, "", good + "\n[page 3 not recognized]", good + "\n$$")).collect()}
    assert (g[0].score, g[0].status, g[0].issues) == (100.0, "ok", [])
    assert g[1].status == "bad" and "empty_body" in g[1].issues
    assert g[2].score == 0 and g[2].issues == ["lost_pages"]
    assert g[3].issues == ["runaway_math"]


def test_clean_passes():
    c = cleaning.cleaned
    assert c("**I**nterface​  \n\n\n\n•  x\n***&&&\n") == "Interface\n\n- x\n"
    assert c("## **Title**\n\n```\n#  keep  \n```\n") == "## Title\n\n```\n#  keep  \n```\n"
    assert c("| a |  |\n| --- | --- |\n| 1 |  |\n") == "| a   |\n| --- |\n| 1   |\n"
    assert c("| a | b | c |\n|---|---|---|\n| X<br>Y | 1<br>2 | 3<br>4 |\n") == "| a   | b   | c   |\n| --- | --- | --- |\n| X   | 1   | 3   |\n| Y   | 2   | 4   |\n"
    assert c("the spillway and the spillway, spill-\nway of it\n") == "the spillway and the spillway, spillway\nof it\n"
    assert c("one two three four\n\n<!-- source:page 2 -->\n\nfive six\n") == "one two three four five six\n\n<!-- source:page 2 -->\n"
    assert c("# 1 A\n#### 1.1 B\n#### 1.2 C\n#### 1.3 D\n") == "### 1 A\n#### 1.1 B\n#### 1.2 C\n#### 1.3 D\n"
    assert c("") == ""


def test_clean_settles(spark):
    for body in [r.body for r in S.bodies(spark, DATA).where("body is not null").collect()]:
        once = cleaning.cleaned(body)
        assert cleaning.cleaned(once) == once


def test_layout(spark):
    rows = [
        (1, 1, 0, 0, "PageHeader", "<p>Head</p>"), (2, 1, 0, 1, "SectionHeader", "<h2>T</h2>"), (3, 1, 0, 2, "Text", "<p>An open end of</p>"),
        (4, 1, 1, 0, "Text", "<p>a paragraph &amp; more.</p>"), (5, 1, 1, 1, "ListItem", "<li>x</li>"), (6, 1, 1, 2, "Table", "<table><tr><td>a</td><td>1</td></tr></table>"), (7, 1, 1, 3, "Text", None),
    ]
    b = spark.createDataFrame(rows, "block_key bigint, result_id bigint, page_id int, block_id int, block_type string, html string")
    assert [(r.block_key, r.next_key) for r in layout.joined_paragraphs(b).collect()] == [(3, 4)]
    assert layout.to_markdown(b).collect()[0].body == "## T\n\nAn open end of\n\na paragraph & more.\n\n- x\n\n| a | 1 |\n| --- | --- |"


def test_sources(spark, tmp_path):
    (tmp_path / "b.md").write_text("---\nstatus: ok\nscore: 7\n---\nText\r\n")
    (tmp_path / "A.md").write_text("x")
    (tmp_path / "c.txt").write_text("no")
    files = S.markdown_files(spark, str(tmp_path))
    assert [r.name for r in files.collect()] == ["A.md", "b.md"]
    got = {r.name: r for r in S.split_header(files).collect()}
    assert got["b.md"].header == {"status": "ok", "score": "7"} and got["b.md"].body == "Text\n" and got["A.md"].header is None
    names = spark.createDataFrame([("a.pdf",), ("b.MD",), ("x:y. .docx",)], "s string").select(S.target_name(F.col("s")).alias("t"))
    assert [r.t for r in names.collect()] == ["a.md", "b_cleaned.md", "x_y.md"]
    done = spark.createDataFrame([("a", "1", "ok"), ("b", "2", "in_progress")], "source string, source_hash string, status string")
    assert [r.source for r in S.unfinished(done, done).collect()] == ["b"]
    S.write_results(done, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_columns(spark):
    df = spark.createDataFrame([("82. 1. Entry", "AB 12,5")], "a string, b string")
    r = df.select(K.entry_number_joined(F.col("a")).alias("a"), K.value_form(F.col("b")).alias("b")).collect()[0]
    assert (r.a, r.b) == ("82.1. Entry", "A 9,9")
