"""Language models as providers: the interface, retries with growing pauses, and budgets of requests and tokens.

Nothing here calls out by itself. A caller gives a function that sends one request; the clock and the pause are given as well, so
a run can be tested without waiting.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Callable


class Refused(Exception):
    """A provider's no: whether it may be asked again, and after how many seconds."""

    def __init__(self, why: str, again: bool = True, after: float | None = None):
        super().__init__(why)
        self.again, self.after = again, after


class Budget:
    """Requests of a day. Counts are the caller's to keep: `counts` maps (day, model) to requests."""

    def __init__(self, limit: int | None, counts: dict[tuple[str, str], int] | None = None):
        self.limit, self.counts = limit, {} if counts is None else counts

    def has_room(self, day: str, model: str) -> bool:
        return self.limit is None or self.counts.get((day, model), 0) < self.limit

    def reserve(self, day: str, model: str) -> bool:
        if not self.has_room(day, model):
            return False
        self.counts[day, model] = self.counts.get((day, model), 0) + 1
        return True


class Pacer:
    """Spaces requests so that no minute holds more tokens than allowed; a request larger than that goes alone."""

    def __init__(self, tokens: int, clock: Callable[[], float] = time.monotonic, pause: Callable[[float], None] = time.sleep):
        self.tokens, self.clock, self.pause = tokens, clock, pause
        self.sent: deque[tuple[float, int]] = deque()

    def wait(self, tokens: int) -> None:
        while True:
            now = self.clock()
            while self.sent and now - self.sent[0][0] >= 60:
                self.sent.popleft()
            if not self.sent or sum(n for _, n in self.sent) + tokens <= self.tokens:
                self.sent.append((now, tokens))
                return
            self.pause(60 - (now - self.sent[0][0]))


class Provider(ABC):
    """One model. `send` asks once and raises Refused; `generate` asks until it answers, at most `tries` times."""

    name = "provider"

    def __init__(self, budget: Budget | None = None, pacer: Pacer | None = None, tries: int = 5, first_pause: float = 1.0, pause: Callable[[float], None] = time.sleep, day: Callable[[], str] = lambda: time.strftime("%Y-%m-%d")):
        self.budget, self.pacer, self.tries, self.first_pause, self.pause, self.day = budget or Budget(None), pacer, tries, first_pause, pause, day

    def available(self) -> bool:
        return self.budget.has_room(self.day(), self.name)

    @abstractmethod
    def send(self, prompt: str) -> str: ...

    def generate(self, prompt: str) -> str:
        pause = self.first_pause
        for k in range(self.tries):
            if not self.budget.reserve(self.day(), self.name):
                raise Refused("no requests left today", again=False)
            if self.pacer:
                self.pacer.wait(-(-len(prompt) // 3))
            try:
                return self.send(prompt)
            except Refused as no:
                if not no.again or k + 1 == self.tries:
                    raise
                self.pause(no.after if no.after is not None else pause)
                pause *= 2
        raise Refused("no tries left", again=False)


class Called(Provider):
    """A provider out of a function."""

    def __init__(self, call: Callable[[str], str], name: str = "called", **how):
        super().__init__(**how)
        self.call, self.name = call, name

    def send(self, prompt: str) -> str:
        return self.call(prompt)


def halved(chunks: list[list[str]], send: Callable[[str], str], separator: str = "\n") -> list[tuple[list[str], str | None]]:
    """(lines, reply) of each chunk; a chunk that is refused is halved and asked again, a single line that is refused has no reply."""
    out: list[tuple[list[str], str | None]] = []
    todo = list(reversed(chunks))
    while todo:
        lines = todo.pop()
        try:
            out.append((lines, send(separator.join(lines))))
        except Refused:
            if len(lines) < 2:
                out.append((lines, None))
            else:
                mid = len(lines) // 2
                todo += [lines[mid:], lines[:mid]]
    return out
