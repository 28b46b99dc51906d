"""Planted tables, grading thresholds, queue, media, providers and streams."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import columns as K
from quire.operators import findings, layout
from quire.operators import lines as L
from quire.operators import tables as T
from quire.plans import catalog, finish, grading
from quire.sources import media, provider, queue
from quire.sources import tables as S
from quire.streaming import assembly
from quire.streaming import events as E

BLOCK = "block_key bigint, result_id bigint, page_id int, block_id int, block_type string, html string, polygon array<array<double>>, section_hierarchy map<int,string>, ingested_at timestamp"
RESULT = "result_id bigint, body string, pages int, lang string, archive_id string, ingested_at timestamp"


def box(x0, y0, x1, y1):
    return [[float(x), float(y)] for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Rows for the rules that the given tables hardly show."""
    folder = str(tmp_path_factory.mktemp("planted"))
    blocks = []

    def add(result, page, kind, html, at=(50, 100, 550, 120)):
        n = len(blocks)
        blocks.append((n, result, page, n, kind, html, box(*at), None, None))

    for page in range(5):
        add(1, page, "Text", f"<p>Old Quay {page}</p>", (50, 10, 200, 20))
        add(1, page, "Picture", "", (50, 30 + page * 0.5, 90, 60))
        add(1, page, "Text", "<p>The men carried the gauge to</p>" if page % 2 == 0 else "<p>the river and came back.</p>", (50, 300, 550, 320))
        if page % 2:
            add(1, page, "Table", "<table><tr><td>1,5</td><td>valve</td></tr></table>", (50, 90, 550, 99))
        add(1, page, "Table", "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", (50, 700, 550, 780))
        add(1, page, "Text", "<p>foot</p>", (50, 800, 200, 810))
    add(2, 0, "Text", "<p>1 a<br/>2 b<br/>3 c</p>")
    add(2, 0, "Footnote", "<p>3) See the ledger.</p>")
    add(2, 0, "Footnote", "<p>Nothing marked</p>")
    add(2, 0, "Text", None)
    for page in range(4):
        add(3, page, "Text", "<p>The men carried the gauge to</p>" if page % 2 == 0 else "<p>the river and came back.</p>")
    spark.createDataFrame(blocks * 2, BLOCK).write.parquet(f"{folder}/block_outputs.parquet")
    bodies = [
        "| a |  |\n|---|---|\n| 1 |  |\n\n<!-- source:page 2 -->\n\n| a |  |\n|---|---|\n| 2 |  |\n| 3 |",
        "x\nsame\nsame\nsame\ny\n\nq\n\nq\n\nq\n",
        "turbine " * 20 + "turbino\n\nice-cold icecold icecold icecold",
        "---\ntitle: x\n---\n```\n~~~\n# no\n```\n# Contents\n\n1 Valves ..... 3\n2 Shafts ..... 4\n\n#Glued\n### Deep\n\nTitle\n===\n\n====\n",
        "$$a = \\frac{b$$ and $c$ $\\left( d$ $\\begin{array} e$\n$$\n# x\n$$\nЗначение $ 5 ~\\kappa\\Gamma$ кг",
        "The valve �� " + "Ж" * 10 + "α" * 300,
        "| a | b |\n|---|---|\n" + "| 1 |\n" * 5 + "| 1 | 2 |\n" + "\n".join(f"The same line\nfiller {k} of it" for k in range(40)),
        None,
        "",
    ]
    spark.createDataFrame([(i, b, 1, None, None, None) for i, b in enumerate(bodies)] * 2, RESULT).write.parquet(f"{folder}/ocr_results.parquet")
    spark.createDataFrame([(i, None, None, "partial (1/5)" if i == 0 else "none", None, None) for i in range(9)], "result_id bigint, source string, status string, inspection string, source_hash string, ingested_at timestamp").write.parquet(f"{folder}/result_headers.parquet")
    return folder


PLANTED = {
    "repeated_line_runs": 1, "repeated_blocks": 1, "split_tables": 1, "empty_columns": 2, "near_words": 1, "compound_hyphens": 1, "image_furniture": 5, "joined_paragraphs": 2, "merged_tables": 4, "common_elements": 10, "line_zones": 8,
    "heading_jumps": 1, "junk_lines": 1, "repeat_groups": 2, "footnotes": 2, "list_levels": 0, "grade_documents": 8, "body_measures": 8, "page_chunks": 9, "table_shapes": 3, "section_parents": 4, "reading_order": 0, "line_addresses": 0,
}


@pytest.mark.parametrize("name", sorted(PLANTED))
def test_planted(spark, planted, name):
    from tests.test_core import plain

    con = duckdb.connect()
    for t in ("ocr_results", "block_outputs", "result_headers"):
        con.execute(f"create view {t} as select * from '{planted}/{t}.parquet/*.parquet'")
    mine = catalog.QUERIES[name](spark, planted).toPandas()
    theirs = con.execute(catalog.SQL[name]).df()
    rows = [sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str) for df in (mine, theirs)]
    assert rows[0] == rows[1]
    assert len(mine) == PLANTED[name] or not PLANTED[name]


def grade(spark, *texts, pages=None):
    df = spark.createDataFrame([(i, t, pages) for i, t in enumerate(texts)], "result_id bigint, body string, pages int")
    return {r.result_id: r for r in grading.grade(df).collect()}, {(r.result_id, r.name): r for r in grading.checks(grading.measures(df)).collect()}


def test_thresholds(spark):
    filler = "\n".join(f"The text of line {'abcdefghij'[k % 10] * (k // 10 + 1)} goes on here." for k in range(97))
    tables = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |"
    _, checks = grade(spark, filler + "\nsame one\nsame one\nsame one", filler + "\n" + tables, filler + "\nsame one" * 31, filler.replace("goes on here.", "goes on he-", 4).replace("The text", "the text"))
    assert checks[0, "repeats"].halvings == pytest.approx(10) and not checks[0, "repeats"].veto and checks[2, "repeats"].veto
    assert checks[1, "tables"].halvings == pytest.approx(1 / (101 / 1000))
    assert checks[3, "hyphenation"].halvings == pytest.approx((4 - 2) / 2)
    assert checks[0, "headings"].halvings == 0 and checks[0, "unreadable_chars"].halvings == 0


def test_grades_of_scripts_and_formulas(spark):
    mojibake = "Ïðèâåò " * 60 + "Привет " * 10
    latin = "The valve was closed before noon. " * 30
    greek = latin + "α" * 200
    g, checks = grade(spark, mojibake, latin, greek, latin + "$\\frac{a$ $b{$ $c{$ $d{$", latin + "\n$$", latin + "\n$$\n# x\n$$")
    assert checks[0, "unreadable_chars"].veto and not checks[1, "unreadable_chars"].veto and checks[1, "unreadable_chars"].halvings == 0
    assert checks[2, "unreadable_chars"].halvings == pytest.approx(200 / (len(latin.replace(" ", "").replace(".", "")) + 200) / 0.15)
    assert checks[3, "formulas"].halvings == pytest.approx((4 - 2) / 2) and checks[4, "runaway_math"].veto and checks[5, "runaway_math"].veto
    assert g[1].status == "ok" and g[4].score == 0


def test_density_and_inspection(spark):
    g, _ = grade(spark, "The valve was closed before noon. " * 20, pages=2)
    assert "text_density" in g[0].issues
    df = spark.createDataFrame([(1, "The valve was closed. " * 30, 1, 5, 2), (2, "The valve was closed. " * 30, 1, 4, 3)], "result_id bigint, body string, pages int, chunks int, done int")
    by = {r.result_id: r for r in grading.grade(df).collect()}
    assert by[1].issues == ["inspection_coverage"] and by[1].score == 0 and by[2].issues == [] and by[2].score == pytest.approx(70.7)


def test_zone_reading_is_one(spark):
    from quire.operators.zones import read

    body = "---\na\n---\n````\n```\n````\n<table>\n</table>\nT\n==\n$$\nx\n$$"
    rows = L.zoned(spark.createDataFrame([(1, body, 3)], "result_id bigint, body string, pages int"), "pages").orderBy("line_no").collect()
    assert [(r.line_no, r.line, r.protected, r.display, r.page, r.underline) for r in rows] == list(read(body)) and {r.pages for r in rows} == {3}


def test_layout_rules(spark, planted):
    blocks = spark.read.parquet(f"{planted}/block_outputs.parquet").dropDuplicates(["block_key"])
    assert {(r.lines, r.numbered) for r in layout.numbered_margins(blocks).collect()} == {(3, 3)}
    assert {r.repeats_header for r in layout.merged_tables(blocks).collect()} == {True, False}
    heads = [(k, 1, 0, k, "SectionHeader", "<h1>x</h1>", box(50, 100, 300, 100 + h), None, None) for k, h in enumerate([20, 20, 14, 10, 14])]
    assert {r.block_key: r.level for r in layout.heading_heights(spark.createDataFrame(heads, BLOCK)).collect()} == {0: 1, 1: 1, 2: 2, 3: 3, 4: 2}
    texts = [(k, 1, 0, k, "Text", "<p>x</p>", box(x0, 100 + k * 20, x1, 115 + k * 20), None, None) for k, (x0, x1) in enumerate([(50, 550), (62, 530), (80, 520), (62, 550)])]
    assert {r.block_key: r.level for r in layout.quote_levels(spark.createDataFrame(texts, BLOCK)).collect()} == {1: 1, 2: 3}


def test_plain_characters(spark):
    df = spark.createDataFrame([("ofﬁce \tx\r\ny\u0007",)], "t string")
    assert df.select(K.plain_characters(F.col("t")).alias("t")).collect()[0].t == "office  x\ny"


def test_queue(spark, tmp_path):
    files = {"a.pdf": b"%PDF-1.7 x", "b.pdf": b"no pdf", "c.md": b"text", "A.md": b"other", "d.bin": b"x", "x_cleaned.md": b"done", "f.txt": b"a\0b", "con.pdf": b"%PDF", "a.docx": b"PK\x03\x04"}
    folder = tmp_path / "in"
    folder.mkdir()
    for name, content in files.items():
        (folder / name).write_bytes(content)
    sources = queue.found(spark, str(folder))
    assert {r["name"]: r.defect for r in sources.collect()} == {"a.pdf": None, "b.pdf": "wrong signature", "c.md": None, "A.md": None, "d.bin": "unknown kind", "f.txt": "binary content", "con.pdf": None, "a.docx": None}
    assert spark.createDataFrame([("e.pdf", b"")], "n string, c binary").select(queue.defect(F.col("n"), F.col("c")).alias("d")).collect()[0].d == "empty"
    done = sources.where("name = 'c.md'").select(F.col("name").alias("source"), "source_hash", F.lit("ok").alias("status"))
    q = queue.build(sources, done)
    assert {r["name"] for r in q.collect()} == {"a.pdf", "A.md", "con.pdf", "a.docx"} and {r["name"] for r in queue.build(sources, done, ["pdf"]).collect()} == {"a.pdf", "con.pdf"}
    assert {r["name"]: r.target for r in queue.named(q).collect()} == {"a.pdf": "a_pdf.md", "a.docx": "a_docx.md", "A.md": "A_cleaned.md", "con.pdf": "con_.md"}
    path = str(tmp_path / "queue")
    queue.save(q, path)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        queue.save(q, path)
    assert queue.load(spark, path).count() == 4 and {r.status for r in queue.stubs(queue.load(spark, path)).collect()} == {"in_progress"}
    queue.remove(spark, path)
    assert not (tmp_path / "queue").exists()
    for statuses, code in ((["ok"], 0), (["ok", "bad"], 4), (["bad", "in_progress"], 1), (["ok", "interrupted"], 130)):
        assert queue.exit_code(spark.createDataFrame([(s,) for s in statuses], "status string")).collect()[0].exit_code == code


def test_media(spark):
    paths = spark.createDataFrame([("a b(1).png",), ("http://x/y.png",), ("../z.png",), ("a%20b.png?x",)], "p string")
    assert paths.select(media.link_path(F.col("p")).alias("x")).collect()[0].x == "a%20b%281%29.png"
    assert [r.x for r in paths.select(media.local_path(F.col("p")).alias("x")).collect()] == ["a b(1).png", None, None, "a b.png"]
    files = spark.createDataFrame([(1, f"p{k}.png", k, b"x" * (600 if k < 3 else 700 + k)) for k in range(5)] + [(1, "tiny.png", 9, b"x")], "result_id bigint, path string, page int, content binary")
    assert {(r.path, r.kept) for r in media.copies(files).collect()} == {("p1.png", "p0.png"), ("p2.png", "p0.png")}
    assert {r.path for r in media.furniture(files).collect()} == {"p0.png", "p1.png", "p2.png", "tiny.png"}
    bodies = spark.createDataFrame([(1, "![A map](p1.png) ![](p9.png) ![x](q.png)"), (2, None)], "result_id bigint, body string")
    targets = spark.createDataFrame([(1, "p1.png", "p0.png"), (1, "p9.png", None)], "result_id bigint, old string, new string")
    assert [r.body for r in media.rewritten(bodies, targets).collect()] == ["![A map](p0.png)  ![x](q.png)"]
    there = files.select("result_id", F.col("path").alias("target"))
    assert [r.target for r in findings.broken_images(bodies.where("body is not null"), there).orderBy("target").collect()] == ["p9.png", "q.png"]


def test_providers():
    waits, answers = [], iter([provider.Refused("busy"), provider.Refused("busy", after=7), "yes"])

    def call(prompt):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    p = provider.Called(call, pause=waits.append, budget=provider.Budget(4), day=lambda: "d")
    assert p.generate("x") == "yes" and waits == [1.0, 7] and p.available()
    p.budget.reserve("d", "called")
    with pytest.raises(provider.Refused, match="left today"):
        p.generate("x")
    now = [0.0]
    pacer = provider.Pacer(100, clock=lambda: now[0], pause=lambda s: now.__setitem__(0, now[0] + s))
    for n in (60, 60, 500):
        pacer.wait(n)
    assert now[0] == 120

    def picky(text):
        if "bad" in text:
            raise provider.Refused("no")
        return text.upper()

    assert provider.halved([["a", "bad", "c", "d"]], picky) == [(["a"], "A"), (["bad"], None), (["c", "d"], "C\nD")]


def test_stream_leaves_late_rows_out(spark, tmp_path):
    """Windows are closed by the watermark; a row that comes after that changes nothing."""
    from datetime import datetime

    batches = [[(1, datetime(2026, 1, 1, 0, 10), "a", 1.0)], [(2, datetime(2026, 1, 3, 0, 0), "a", 1.0)], [(3, datetime(2026, 1, 1, 0, 20), "a", 1.0), (4, datetime(2026, 1, 3, 0, 30), "a", 2.0)], [(5, datetime(2026, 1, 6, 0, 0), "a", 1.0)], [(6, datetime(2026, 1, 9, 0, 0), "a", 1.0)]]
    folder = str(tmp_path / "in")
    schema = "event_id bigint, ts timestamp, event_type string, value double"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = E.tumbling(spark.readStream.schema(schema).parquet(folder))
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()
    got = {(r.start_ts.day, r.n, r.total) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 1, 1.0), (3, 2, 3.0), (6, 1, 1.0)}


@pytest.mark.parametrize("files", [1, 3])
def test_streamed_lines_of_a_file_or_a_folder(spark, tmp_path, files):
    """A table is one file, or a folder of files; a result that comes again, in its file or a later one, or once without a body, counts once."""
    rows = [(1, "a\nb"), (2, ""), (3, None), (3, "a\n\nb\n"), (None, "x"), (4, None), (1, "a\nb"), (5, "a"), (3, None), (2, "")]
    path = tmp_path / "ocr_results.parquet"
    con = duckdb.connect()
    if files > 1:
        path.mkdir()
    for k in range(files):
        part = path / f"part-{k:05}.parquet" if files > 1 else path
        con.execute("create or replace table t (result_id bigint, body varchar, pages int)")
        con.executemany("insert into t values (?, ?, 1)", rows[k * 4 : k * 4 + 4] if files > 1 else rows)
        con.execute(f"copy t to '{part}' (format parquet)")
    got = sorted(map(tuple, catalog.QUERIES["streamed_lines"](spark, str(tmp_path)).collect()))
    con.execute(f"create view ocr_results as from '{path}{'/*.parquet' if files > 1 else ''}'")
    assert got == sorted(con.execute(catalog.SQL["streamed_lines"]).fetchall()) == [(1, 2), (2, 1), (3, 4), (5, 1)]


def test_finished_results(spark, tmp_path):
    body = "**T**itle of it\n\nThe valve was closed by hand before noon, and nobody measured it again.\n\nva-\nlve\n"
    bodies = spark.createDataFrame([(1, body, 1), (2, None, 1), (3, "", 1)], "result_id bigint, body string, pages int")
    sources = spark.createDataFrame([(1, "a.pdf"), (9, "b.pdf")], "result_id bigint, source string")
    rows = {r.result_id: r for r in finish.finished(bodies, sources).collect()}
    assert set(rows) == {1, 3} and rows[1].target == "a.md" and rows[1].findings == 1 and rows[3].target == "result-3.md" and rows[3].status == "bad" and "empty_body" in rows[3].issues
    S.write_markdown(finish.finished(bodies, sources), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.md", "result-3.md"]
    files = {r["name"]: r for r in S.split_header(S.markdown_files(spark, str(tmp_path))).collect()}
    assert files["a.md"].header["source"] == "a.pdf" and files["a.md"].header["status"] == rows[1].status and files["a.md"].body.startswith("Title of it")
    from quire.functions import columns as K

    clean = spark.createDataFrame([(files["a.md"].body,)], "b string").select(K.url_hash(F.encode("b", "UTF-8")).alias("h")).collect()[0].h
    assert files["a.md"].source_hash == clean
    with pytest.raises(Exception, match="outside of the folder"):
        S.write_markdown(spark.createDataFrame([("../x.md", "t")], "target string, text string"), str(tmp_path))


def test_pages_are_assembled(spark, tmp_path):
    """A body leaves when it is whole, over several batches; one that waits too long leaves with marks for what is missing."""
    from datetime import datetime

    at = lambda h, m=0: datetime(2026, 1, 1, h, m)
    batches = [
        [(1, 1, 2, "one", at(1)), (2, 1, 3, "a", at(1)), (2, 1, 3, "again", at(1)), (None, 1, 1, "x", at(1))],
        [(1, 2, 2, "two", at(1, 5)), (2, 3, 3, "c", at(1, 10)), (4, 1, 1, "whole", at(1, 10))],
        [(3, 1, 2, "late", at(9))],
        [(5, 1, 2, "later", at(20))],
    ]
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "result_id bigint, page int, of int, text string, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = assembly.assembled(spark.readStream.schema(schema).parquet(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    got = {r.result_id: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1].body == "<!-- source:page 1 -->\n\none\n\n<!-- source:page 2 -->\n\ntwo" and got[1].lost == 0 and got[4].body.endswith("whole")
    assert got[2].body == "<!-- source:page 1 -->\n\na\n\n<!-- source:page 2 -->\n\n[page 2 not recognized]\n\n<!-- source:page 3 -->\n\nc" and (got[2].lost, got[2].pages) == (1, 3) and got[3].lost == 1
