"""Pages that arrive one by one, put together into bodies: a body leaves when all its pages are there, or when it has waited too long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BODIES = "result_id bigint, body string, pages int, lost int"
HELD = "pages array<int>, texts array<string>, expected int"


def body_of(pages: dict[int, str], expected: int) -> tuple[str, int]:
    """The pages in order under their marks, a line in place of each that is missing; and how many are."""
    lost = [p for p in range(1, expected + 1) if p not in pages]
    parts = [f"<!-- source:page {p} -->\n\n" + (pages[p] if p in pages else f"[page {p} not recognized]") for p in range(1, max([expected, *pages]) + 1) if p in pages or p <= expected]
    return "\n\n".join(parts), len(lost)


def assembled(pages: DataFrame, wait: str = "1 hour") -> DataFrame:
    """(result_id, body, pages, lost) of a stream of pages (result_id, page, of, text, ts).

    A page that comes twice counts once, the first one; pages without a number are left out. A body of which pages are still
    missing `wait` after its last one, by the watermark, leaves with marks for them. Pages of a body that has left begin a new one.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have: dict[int, str] = {}
        expected = 0
        if state.exists:
            numbers, texts, expected = state.get
            have = dict(zip(numbers, texts))
        latest = 0
        for frame in frames:
            for page, of, text, ts in zip(frame["page"], frame["of"], frame["text"], frame["ts"]):
                if pd.notna(page):
                    have.setdefault(int(page), text or "")
                if pd.notna(of):
                    expected = max(expected, int(of))
                if pd.notna(ts):
                    latest = max(latest, int(ts.timestamp() * 1000))
        if state.hasTimedOut or expected and all(p in have for p in range(1, expected + 1)):
            if state.exists:
                state.remove()
            body, lost = body_of(have, expected)
            yield pd.DataFrame({"result_id": [key[0]], "body": [body], "pages": [max(expected, len(have))], "lost": [lost]})
            return
        state.update((list(have), [have[p] for p in have], expected))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)

    keyed = pages.where("result_id is not null and ts is not null").withWatermark("ts", wait).groupBy("result_id")
    return keyed.applyInPandasWithState(run, BODIES, HELD, "append", GroupStateTimeout.EventTimeTimeout)
