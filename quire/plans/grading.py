"""Grading of bodies: checks with halvings, vetoes, score, verdict and issues.

Lines are read by one kernel and exchanged once by body; all windows and the only aggregate work on that exchange. A check's
score halves with every h of defect, the total with the sum of all halvings; a veto makes it 0.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import columns as K
from quire.operators import lines as L

OK_SCORE = 50.0
CHECKS = (
    "text_density", "empty_body", "unreadable_chars", "formulas", "runaway_math", "greek_units", "headings", "flat_ladder", "lost_chapters", "tables",
    "junk_lines", "repeats", "hyphenation", "flattened_blocks", "lost_pages", "inspection_coverage",
)
#: Titles of printed contents, in lower case (fixed values).
CONTENTS = ("contents", "table of contents", "inhalt", "inhaltsverzeichnis", "sommaire", "table des matières", "содержание", "оглавление")
ENTRY = r"^\W*(\d+)\.?\s+(\S.*?)\s*(\.{3,}|…+|\t|\s{3,})\s*\d+\s*\|?\s*$"
NUMBERED = r"^\d+(\.\d+)*\.?\s+"
GREEK = "alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|upsilon|phi|chi|psi|omega|Gamma|Delta|Theta|Lambda|Xi|Pi|Sigma|Upsilon|Phi|Psi|Omega"
GREEK_UNIT = rf"\$\$?\s*\d+(\s|~)+(\\({GREEK}))(\\({GREEK}))+\s*\$\$?"
KNOWN_UNIT = r"\$\$?\s*\d+(\s|~)+\\mu\\Omega\s*\$\$?"
STRUCTURE = r"(?m)^ {0,3}#{1,6}[ \t]+\S|!\[[^\]\n]*\]\(|^[|:\- \t]*-[|:\- \t]*$"
ACCENTED = "À-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿĀ-ďĒ-ĥĨ-İĴ-ķĹ-ľŃ-ňŌ-őŔ-ťŨ-ž"
IMPOSSIBLE = r"\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F"
#: What is counted among the characters of a whole body.
LETTERS = {"latin": r"\p{Latin}", "cyrillic": r"\p{Cyrillic}", "greek": r"\p{Greek}", "cjk": r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]", "letters": r"\p{L}", "accented": f"[{ACCENTED}]", "impossible": r"[\uFFFD\uE000-\uF8FF\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"}
_kinds: dict[str, tuple[bool, ...]] = {}


def folded(title: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(title, NUMBERED, ""), r"[^\p{L}\p{N}]+", " ")))


def letters_of(body: str) -> list[int]:
    """Characters of a body by LETTERS; kinds of characters are few, so each is looked into once."""
    import regex

    out = [0] * len(LETTERS)
    for c, n in Counter(body).items():
        if (kinds := _kinds.get(c)) is None:
            kinds = _kinds[c] = tuple(bool(regex.match(rule, c)) for rule in LETTERS.values())
        for k, has in enumerate(kinds):
            out[k] += n * has
    return out


def valid_formula(x: Column) -> Column:
    """Not empty, and braces, \\left and \\right, \\begin and \\end in pairs."""
    n = lambda rule: F.regexp_count(x, F.lit(rule))
    braces = n(r"\{") - n(r"\\\{") == n(r"\}") - n(r"\\\}")
    return (F.trim(x) != "") & braces & (n(r"\\left[^A-Za-z]") == n(r"\\right[^A-Za-z]")) & (n(r"\\begin\{") == n(r"\\end\{"))


def spans(text: Column) -> tuple[Column, Column]:
    """Contents of the closed display formulas, and of the inline ones in what is left."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\\\$", "  "), r"`[^`\n]*`", "")
    rest = F.regexp_replace(plain, r"\$\$[^$]*\$\$", " ")
    return F.regexp_extract_all(plain, F.lit(r"\$\$([^$]*)\$\$"), 1), F.regexp_extract_all(rest, F.lit(r"\$([^$\s][^$\n]*)\$"), 1)


def measures(bodies: DataFrame, longest: int = 25, least_run: int = 6, longest_repeat: int = 80, connector: int = 3, gap: int = 3) -> DataFrame:
    """One row per body (result_id, body, pages and, if there are, chunks and done): counts that the checks are made of."""
    extra = [c for c in ("chunks", "done") if c in bodies.columns]
    z = L.zoned(bodies, "pages", *extra, counts=tuple(LETTERS), count=letters_of).repartition("result_id")
    line, plain = F.col("line"), ~F.col("protected")
    core = F.trim("line")
    z = z.withColumn("level", F.when(plain, K.heading_level(line))).withColumn("core", core)
    w, so_far = L.order(), L.so_far()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    z = z.withColumn("above", F.last("level", ignorenulls=True).over(before)).withColumn("next", F.lead("line").over(w)).withColumn("next_protected", F.lead("protected").over(w))
    z = z.withColumn("under", F.last(F.when(F.col("level").isNotNull(), folded(K.heading_title(line))), ignorenulls=True).over(so_far))
    short = plain & (core != "") & (F.length("line") <= longest) & ~line.rlike(K.LIST_ITEM) & ~line.rlike(K.HEADING) & ~line.contains("|") & ~line.contains("$") & ~line.rlike(r"^[<!\[]")
    z = z.withColumn("short", short.cast("int")).withColumn("run", F.row_number().over(w) - F.sum("short").over(so_far))
    row = plain & line.rlike(K.TABLE_ROW)
    z = z.withColumn("row", row.cast("int")).withColumn("table", F.row_number().over(w) - F.sum("row").over(so_far))
    inner = F.regexp_replace(F.regexp_replace("line", r"^\s*\|", ""), r"\|\s*$", "")
    z = z.withColumn("cells", F.when(row, F.size(F.split(inner, r"(?<!\\)\|", -1)))).withColumn("rule", row & line.rlike(K.TABLE_RULE))
    t = Window.partitionBy("result_id", "row", "table").orderBy("line_no")
    every = t.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    z = z.withColumn("row_no", F.row_number().over(t)).withColumn("width", F.max(F.when((F.col("row_no") == 2) & F.col("rule"), F.col("cells"))).over(every))
    # a table of which no row but the rule has the width of the rule is no table of that width
    z = z.withColumn("fits", F.max(((F.col("row_no") != 2) & (F.col("cells") == F.col("width"))).cast("int")).over(every))
    r = Window.partitionBy("result_id", "short", "run").orderBy("line_no")
    z = z.withColumn("run_lines", F.count("*").over(r.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("run_at", F.row_number().over(r))
    design = line.rlike(K.HEADING) | K.has_cells(core) | core.rlike(K.MEDIA) | (F.regexp_replace(core, K.ANY_FORMULA, "") == "") | (~core.rlike(r"\s") & (F.length(core) <= connector)) | line.rlike(K.PAGE_MARK)
    z = z.withColumn("may", (plain & core.rlike(r"[\p{L}\p{N}]") & (F.length(core) <= longest_repeat) & ~design).cast("int"))
    same = Window.partitionBy("result_id", "may", "core").orderBy("line_no")
    z = z.withColumn("gap", F.col("line_no") - F.lag("line_no").over(same)).withColumn("copy", F.row_number().over(same))
    count = lambda c: F.count(F.when(c, 1))
    by = z.groupBy("result_id", "may", "core").agg(
        F.count("*").alias("copies"), F.median("gap").alias("median_gap"), F.max("pages").alias("pages"), *[F.max(c).alias(c) for c in (*extra, *LETTERS)],
        count(core != "").alias("filled"), F.sum(F.length("line") + 1).alias("chars"), F.sum(K.alnum(line)).alias("alnum"),
        count(F.col("level").isNotNull()).alias("headings"), count((F.col("level") > F.col("above") + 1) | (plain & line.rlike(K.GLUED))).alias("jumps"),
        count(plain & (core != "") & K.is_junk(line, F.col("underline"))).alias("junk"), count(row).alias("table_rows"),
        count((F.col("row") == 1) & F.col("width").isNotNull() & (F.col("fits") == 1) & (F.col("cells") != F.col("width"))).alias("broken_rows"),
        count(plain & ~F.col("display") & ~F.col("next_protected") & line.rlike(r"\p{L}-\s*$") & F.col("next").rlike(r"^\s*\p{Ll}")).alias("hyphens"),
        count((F.col("short") == 1) & (F.col("run_at") == 1) & (F.col("run_lines") >= least_run)).alias("flat_runs"),
        count(line.rlike(K.LOST_PAGE)).alias("lost"),
        F.sum(F.when(plain & F.regexp_replace(line, K.ANY_FORMULA, "").rlike(r"\p{IsCyrillic}"), F.regexp_count("line", F.lit(GREEK_UNIT)) - F.regexp_count("line", F.lit(KNOWN_UNIT))).otherwise(0)).alias("greek_units"),
        F.collect_list(F.when(plain, F.struct("line_no", "line"))).alias("text"),
        F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", F.when(K.heading_title(line).rlike(NUMBERED), F.regexp_count(F.regexp_extract(K.heading_title(line), r"^([\d.]+)", 1), F.lit(r"\d+"))).otherwise(0).alias("depth")))).alias("heads"),
        F.collect_set(F.when(F.col("level").isNotNull(), folded(K.heading_title(line)))).alias("written"),
        F.collect_set(F.when(plain & F.col("under").isin(*CONTENTS) & line.rlike(ENTRY), folded(F.regexp_extract("line", ENTRY, 2)))).alias("chapters"),
    )
    sums = ["copies", "filled", "chars", "alnum", "headings", "jumps", "junk", "table_rows", "broken_rows", "hyphens", "flat_runs", "lost", "greek_units"]
    grouped = (F.col("may") == 1) & (F.col("median_gap") <= gap)
    out = by.groupBy("result_id").agg(
        *[F.sum(c).alias("lines" if c == "copies" else c) for c in sums], *[F.max(c).alias(c) for c in ("pages", *extra, *LETTERS)],
        F.collect_list(F.when(grouped & (F.col("copies") >= 3), F.col("copies"))).alias("repeats"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("text", "heads", "written", "chapters")],
    )
    out = out.withColumn("text", F.array_join(F.transform(F.array_sort("text"), lambda x: x["line"]), "\n"))
    display, inline = spans(F.col("text"))
    out = out.withColumn("display", display).withColumn("inline", inline)
    main = F.greatest("latin", "cyrillic", "greek", "cjk")
    own = F.when(F.col("latin") == main, F.col("latin") + F.col("cyrillic")).otherwise(main + F.col("latin"))
    levels = F.transform("heads", lambda h: h["level"])
    per_level = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.size(F.filter(levels, lambda v: v == k)))
    modal = F.array_position(per_level, F.array_max(per_level)).cast("int")
    depths = F.filter(F.transform("heads", lambda h: h["depth"]), lambda d: d > 0)
    flat = (F.size("heads") >= 3) & (3 * F.array_max(per_level) > 2 * F.size("heads")) & (F.size(F.array_distinct(depths)) >= 2)
    least = F.greatest(F.lit(3.0), F.col("lines") / 1000)
    return out.select(
        "result_id", "pages", *extra, *["lines" if c == "copies" else c for c in sums],
        F.size(F.filter("repeats", lambda c: c >= least)).cast("long").alias("repeat_groups"), F.coalesce(F.array_max(F.filter("repeats", lambda c: c >= least)), F.lit(0)).alias("most_copies"),
        F.when(flat, F.size(F.filter("heads", lambda h: (h["level"] == modal) & (h["depth"] > F.array_min(depths))))).otherwise(0).cast("long").alias("flat_ladder"),
        F.size("chapters").cast("long").alias("chapters"), F.size(F.array_except("chapters", "written")).cast("long").alias("lost_chapters"),
        (F.size("display") + F.size("inline")).cast("long").alias("formulas"), F.size(F.filter(F.concat("display", "inline"), lambda x: ~valid_formula(x))).cast("long").alias("bad_formulas"),
        F.regexp_count(F.regexp_replace(F.regexp_replace("text", r"\\\$", "  "), r"`[^`\n]*`", ""), F.lit(r"\$\$")).cast("long").alias("display_signs"),
        F.size(F.filter("display", lambda x: x.rlike(STRUCTURE) | (F.length(x) > 3000) | (F.regexp_count(x, F.lit("\n")) >= 40))).cast("long").alias("runaway"),
        (F.col("letters") + F.col("impossible")).cast("long").alias("sample"), (F.greatest(F.lit(0), F.col("letters") - own) + F.col("impossible")).cast("long").alias("unreadable"),
        "letters", "accented", "cyrillic",
    )


def scaled(floor: float, rate: float) -> Column:
    """A threshold that grows with the lines of the body."""
    return F.greatest(F.lit(float(floor)), F.lit(float(rate)) * F.col("lines") / F.lit(1000.0))


def checks(measures: DataFrame) -> DataFrame:
    """(result_id, name, halvings, veto): one row per check."""
    over = lambda c, floor, rate: F.greatest(F.lit(0.0), F.col(c) - F.lit(float(floor))) / scaled(floor, rate)
    no, none = F.lit(False), F.lit(0.0)
    share = F.col("unreadable") / F.greatest(F.col("sample"), F.lit(1))
    mojibake = (F.col("cyrillic") >= 0.05 * F.col("letters")) & (F.col("accented") > 0.15 * F.col("letters"))
    undone = (F.col("chunks") - F.col("done")) / F.col("chunks") if "chunks" in measures.columns else F.lit(None).cast("double")
    rows = {
        "text_density": (none, F.coalesce((F.col("pages") > 0) & (F.col("chars") - 1 < 350 * F.col("pages")), no)),
        "empty_body": (none, F.col("alnum") < 20),
        "unreadable_chars": (F.when(F.col("sample") >= 200, share / 0.15).otherwise(0.0), (F.col("sample") >= 200) & mojibake),
        "formulas": (over("bad_formulas", 2, 1), no),
        "runaway_math": (none, (F.col("display_signs") % 2 == 1) | (F.col("runaway") > 0)),
        "greek_units": (F.col("greek_units").cast("double"), no),
        "headings": (over("jumps", 1, 2), no),
        "flat_ladder": (over("flat_ladder", 0, 2), no),
        "lost_chapters": (F.greatest(none, F.col("lost_chapters") - F.lit(1.0)) / F.greatest(F.lit(1.0), F.col("chapters") / 4), no),
        "tables": (over("broken_rows", 0, 1), no),
        "junk_lines": (F.col("junk") / F.greatest(F.col("filled"), F.lit(1)) / F.lit(0.02), no),
        "repeats": (over("repeat_groups", 0, 1), F.col("most_copies") > 10 * F.greatest(F.lit(3.0), F.col("lines") / 1000)),
        "hyphenation": (over("hyphens", 2, 2), no),
        "flattened_blocks": (over("flat_runs", 2, 2), no),
        "lost_pages": (none, F.col("lost") > 0),
        "inspection_coverage": (F.coalesce(undone / 0.5, none), F.coalesce(undone > 0.5, no)),
    }
    parts = F.array(*[F.struct(F.lit(n).alias("name"), rows[n][0].cast("double").alias("halvings"), rows[n][1].alias("veto")) for n in CHECKS])
    return measures.select("result_id", F.explode(parts).alias("c")).select("result_id", "c.*")


def grades(checks: DataFrame, ok_score: float = OK_SCORE) -> DataFrame:
    """(result_id, score, status, issues): 100 halved by every halving, 0 with a veto; ok from ok_score on."""
    bad = F.col("veto") | (K.halved(F.col("halvings"), 1.0) < 50)
    at = F.array_position(F.array(*[F.lit(c) for c in CHECKS]), F.col("name"))
    out = checks.groupBy("result_id").agg(F.sum("halvings").alias("halvings"), F.max(F.col("veto").cast("int")).alias("veto"), F.array_sort(F.collect_list(F.when(bad, F.struct(at.alias("at"), "name")))).alias("issues"))
    score = F.when(F.col("veto") == 1, 0.0).otherwise(K.halved(F.col("halvings"), 1.0))
    return out.select("result_id", F.bround(score, 1).alias("score"), F.when((F.col("veto") == 0) & (score >= ok_score), "ok").otherwise("bad").alias("status"), F.transform("issues", lambda x: x["name"]).alias("issues"))


def grade(bodies: DataFrame) -> DataFrame:
    return grades(checks(measures(bodies)))
