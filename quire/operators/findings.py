"""Findings: what is wrong in a body and stays there, with its line; nothing is rewritten.

One row per finding: (result_id, line_no, kind, detail), kinds in the order of the lines. Null bodies have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from quire.operators import formulas, grids, headings, prose
from quire.operators.kernels import rows
from quire.operators.zones import segments

SCHEMA = "result_id bigint, line_no int, kind string, detail string"
HYPHEN = re.compile(r"([^\W\d_]+)-\s*$")
SHORT = re.compile(r"^\s*(?:[-*+]|\d{1,9}[.)])\s|^ {0,3}#{1,6}\s|[|$]|^[<!\[]")
IMAGE = re.compile(r"!\[([^\]\n]*)\]\(([^()\s]*)\)")
MINOR = frozenset("a an and at by for from in of on or the to with und von der die das in im am de la le les et du des и в на по с из для".split())


def gap_end(segs: list[list], i: int, most: int = 4) -> int | None:
    """The line after `most` blank or picture lines at the most; page marks don't count."""
    skipped = 0
    for k in range(i + 1, len(segs)):
        line, protected = segs[k]
        if protected:
            return None
        if prose.MARK.match(line):
            continue
        if line.strip() and not IMAGE.fullmatch(line.strip()):
            return k
        skipped += 1
        if skipped > most:
            return None
    return None


def of(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, kind, detail) of a body."""
    segs = segments(text)
    found: list[tuple[int, str, str]] = []
    run: list[int] = []
    dollars = 0
    for i, (line, protected) in enumerate(segs):
        display = not protected and ("$$" in line or dollars % 2 == 1)
        dollars += 0 if protected else line.count("$$")
        if not protected and line.strip() and len(line) <= 25 and not SHORT.search(line):
            run.append(i)
        else:
            if len(run) >= 6:
                found.append((run[0], "flattened-block", f"{len(run)} lines"))
            run = []
        if protected:
            continue
        if (m := HYPHEN.search(line)) and not display:
            k = gap_end(segs, i)
            if k is not None and (n := re.match(r"\s*([^\W\d_]+)", segs[k][0])) and n[1][0].islower():
                found.append((i, "hyphenation" if k == i + 1 else "hyphenation-gap", f"{m[1]}- {n[1]}"))
        if m := headings.HEADING.match(line):
            title = m[3].strip()
            if len(line) > 200 and not headings.number_of(title):
                found.append((i, "flattened-block", f"heading of {len(line)} characters"))
            elif (r := re.match(r"^(.{3,60}?[^\W\d_]{4})\. ([A-ZА-ЯЁÀ-Þ].*)$", title)) and all(w[0].isupper() or w.lower() in MINOR for w in re.findall(r"[^\W\d_]+", r[1])) and len(r[2].split()) > 3:
                found.append((i, "run-in-heading", r[1]))
        for a, b in formulas.spans(line):
            span = line[a:b]
            content = formulas.inside(span)
            if formulas.is_loop(span):
                found.append((i, "broken-formula", "loop"))
            elif span.endswith("$") and formulas.open_environment(content):
                found.append((i, "broken-formula", f"open {formulas.open_environment(content)}"))
        if "$" not in line and "`" not in line:
            found += [(i, "letter-spacing", m.group()) for m in prose.SPACED.finditer(line)]
    if len(run) >= 6:
        found.append((run[0], "flattened-block", f"{len(run)} lines"))
    found += [(r[0], "flattened-paragraphs", f"{len(r)} paragraphs") for r in prose.crushed_runs(segs)]
    found += [(i, "broken-table", what) for i, what in grids.collapsed(segs).items()]
    yield from sorted(found)


def findings(bodies: DataFrame) -> DataFrame:
    """Findings of bodies (result_id, body)."""

    def run(result, body):
        for line, kind, detail in of(body):
            yield result, line, kind, detail

    return rows(bodies.where("body is not null").select("result_id", "body"), run, SCHEMA)


def broken_images(bodies: DataFrame, files: DataFrame) -> DataFrame:
    """(result_id, line_no, target): local pictures whose file isn't among files (result_id, target). A target that leaves the
    folder of its result is broken as well."""
    from pyspark.sql import functions as F

    from quire.operators.zones import zoned

    links = zoned(bodies).where("not protected").select("result_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(IMAGE.pattern), 2)).alias("target"))
    local = links.where(~F.col("target").rlike(r"^(?i:[a-z][a-z0-9+.-]*:|//|#)"))
    there = local.join(files.select("result_id", "target").distinct().withColumn("there", F.lit(True)), ["result_id", "target"], "left")
    return there.where(F.col("there").isNull() | F.col("target").rlike(r"(^|/)\.\.(/|$)|^/")).select("result_id", "line_no", "target")

