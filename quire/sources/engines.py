"""Engines that turn sources into bodies: the interface, and a registry by kind of file.

An engine takes a queue (path, name, kind, content) and gives (path, body, pages, method); the registry sends each kind
to the first engine that takes it. Recognition itself is not part of this library: an engine wraps it, best as a function over
Arrow batches, so that a cluster runs it beside the data.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BODIES = "path string, body string, pages int, method string"


class Engine(ABC):
    name = "engine"
    kinds: tuple[str, ...] = ()

    @abstractmethod
    def convert(self, queue: DataFrame) -> DataFrame: ...


class Texts(Engine):
    """Markdown and plain text as they stand: line ends of one sign, one page."""

    name, kinds = "texts", ("md", "markdown", "txt")

    def convert(self, queue: DataFrame) -> DataFrame:
        body = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
        return queue.select("path", body.alias("body"), F.lit(1).alias("pages"), F.lit(self.name).alias("method"))


class Called(Engine):
    """An engine out of a function: convert(content, name) gives (body, pages). What it can't take has no body."""

    def __init__(self, name: str, kinds: tuple[str, ...], call: Callable[[bytes, str], tuple[str, int]]):
        self.name, self.kinds, self.call = name, kinds, call

    def convert(self, queue: DataFrame) -> DataFrame:
        call, method = self.call, self.name
        out = pa.schema([("path", pa.string()), ("body", pa.string()), ("pages", pa.int32()), ("method", pa.string())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for path, name, content in zip(*(batch.column(n).to_pylist() for n in ("path", "name", "content"))):
                    try:
                        body, pages = call(content, name)
                    except Exception:  # noqa: BLE001 one source must not end the run
                        body, pages = None, None
                    found.append((path, body, pages, method))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out)

        return queue.select("path", "name", "content").mapInArrow(run, BODIES)


class Registry:
    def __init__(self, *engines: Engine):
        self.engines: list[Engine] = list(engines)

    def register(self, engine: Engine) -> None:
        self.engines.append(engine)

    def of(self, kind: str) -> Engine | None:
        return next((e for e in self.engines if kind in e.kinds), None)

    def convert(self, queue: DataFrame) -> DataFrame:
        """Bodies of a queue; sources of a kind that no engine takes have a row without a body."""
        parts, taken = [], []
        for engine in self.engines:
            kinds = [k for k in engine.kinds if k not in taken]
            taken += kinds
            parts.append(engine.convert(queue.where(F.col("kind").isin(*kinds))))
        none = F.lit(None)
        rest = queue.where(~F.col("kind").isin(*taken)) if taken else queue
        out = rest.select("path", none.cast("string").alias("body"), none.cast("int").alias("pages"), none.cast("string").alias("method"))
        for part in parts:
            out = out.unionByName(part.select("path", "body", "pages", "method"))
        return out
