"""The one reading of a body's lines: what is protected, what stands in display formulas, the page above, underlines.

Front matter, fences and HTML tables are protected. A fence closes on a line of its own sign, as long as the opening one or
longer, with nothing behind it; a backtick fence can't have a backtick in its text. An opening `---` without a closing one is
a rule. A null body has no lines, an empty one has one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*(.*)$")
ATX = re.compile(r"^ {0,3}#{1,6}[ \t]+\S")
MARK = re.compile(r"^<!-- source:page (\d+) -->$")
UNDERLINE = re.compile(r"=+|-+")


def segments(text: str) -> list[list]:
    """[line, protected] of all lines."""
    lines = text.split("\n")
    out: list[list] = []
    i = 0
    if lines[0] == "---":
        end = next((k for k in range(1, len(lines)) if lines[k] == "---"), None)
        if end is not None:
            out = [[x, True] for x in lines[: end + 1]]
            i = end + 1
    fence, depth = "", 0
    for line in lines[i:]:
        m = FENCE.match(line) if "```" in line or "~~~" in line else None
        if fence:
            out.append([line, True])
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            continue
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
            out.append([line, True])
            continue
        low = line.lower() if "<" in line else ""
        opened = low.count("<table") - low.count("</table>")
        out.append([line, depth > 0 or "<table" in low or opened != 0])
        depth = max(0, depth + opened)
    return out


def is_underline(line: str, above: str) -> bool:
    """`===` or `---` under a line with a letter or digit that is no heading itself."""
    return bool(UNDERLINE.fullmatch(line.strip())) and any(c.isalnum() for c in above) and not ATX.match(above)


def read(text: str) -> Iterator[tuple[int, str, bool, bool, int | None, bool]]:
    """(line number, line, protected, display, page, underline) of all lines."""
    dollars, page, above = 0, None, ""
    for i, (line, protected) in enumerate(segments(text)):
        if m := MARK.match(line):
            page = int(m[1])
        own = 0 if protected else line.count("$$")
        yield i, line, protected, own > 0 or dollars % 2 == 1, page, not protected and is_underline(line, above)
        dollars += own
        above = "" if protected else line


def zoned(bodies: DataFrame, *carried: str, counts: tuple[str, ...] = (), count=None) -> DataFrame:
    """One row per line of bodies (result_id, body): (result_id, carried..., line_no, line, protected, display, page, underline).

    count(body) gives the bigint columns `counts` of a whole body; they stand in the row of its first line, and are null below.
    """
    names = ["result_id", *carried]
    kinds = dict(bodies.select(*names).dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", line_no int, line string, protected boolean, display boolean, page int, underline boolean" + "".join(f", {n} bigint" for n in counts)
    out = to_arrow_schema(bodies.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in out]
            keys = [batch.column(k).to_pylist() for k in range(len(names))]
            for k, body in enumerate(batch.column(len(names)).to_pylist()):
                rows = list(zip(*read(body)))
                for c, values in zip(columns[: len(names)], keys):
                    c.extend([values[k]] * len(rows[0]))
                for c, values in zip(columns[len(names) :], rows):
                    c.extend(values)
                for c, value in zip(columns[len(names) + 6 :], count(body) if counts else ()):
                    c.extend([value] + [None] * (len(rows[0]) - 1))
                if len(columns[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)
                    columns = [[] for _ in out]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return bodies.where("body is not null").select(*names, "body").mapInArrow(run, schema)
