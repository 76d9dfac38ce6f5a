"""What stands around the engine: arguments, tool schemas, result cache, progress and cancellation."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class SearchArguments:
    query: str
    top: int = 5
    content_type: str = ""
    strategy: str = "semantic"


def parse_search(words: list[str], keep_unknown: bool = True) -> SearchArguments:
    """A search from command words: --top or -t N, --text-only, --images-only, --strategy NAME; the rest is the query.

    Unknown options stay in the query of a shell (``keep_unknown``) and drop out of a command's.
    """
    found, rest, only = SearchArguments(""), [], set()
    words = iter(words)
    for word in words:
        if word in ("--top", "-t"):
            number = next(words, "")
            found.top = int(number) if number.isdigit() and int(number) > 0 else found.top
        elif word in ("--images-only", "--image-only"):
            only.add("image")
        elif word == "--text-only":
            only.add("text")
        elif word == "--strategy":
            found.strategy = next(words, found.strategy)
        elif keep_unknown or not word.startswith("--"):
            rest.append(word)
    if len(only) > 1:
        raise ValueError("--text-only and --images-only exclude each other")
    found.query, found.content_type = " ".join(rest), next(iter(only), "")
    return found


def _schema(required: tuple[str, ...] = (), **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(required)}


_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}
#: The arguments of each tool of ``engine.Index``.
TOOL_SCHEMAS = {
    "search": _schema(("query",), query=_TEXT, strategy=_TEXT | {"enum": ["semantic", "keyword", "hybrid"]}, top=_NUMBER),
    "status": _schema(),
    "read_file": _schema(("path",), path=_TEXT),
    "list_dir": _schema(path=_TEXT),
    "update": _schema(),
    "get_file_chunks": _schema(("path",), path=_TEXT),
    "get_file_info": _schema(("path",), path=_TEXT),
    "find_files": _schema(file_type=_TEXT, name_contains=_TEXT, modified_after=_TEXT, modified_before=_TEXT, subfolder=_TEXT, limit=_NUMBER),
}


@dataclass
class ResultCache:
    """Search results by their arguments for five minutes; a changed index drops its own."""

    ttl: float = 300.0
    clock: Callable[[], float] = time.monotonic
    _kept: dict = field(default_factory=dict)

    def get(self, index: str, arguments: tuple, find: Callable[[], list]) -> list:
        now = self.clock()
        self._kept = {k: v for k, v in self._kept.items() if v[0] > now}
        key = (index, arguments)
        if key not in self._kept:
            self._kept[key] = (now + self.ttl, find())
        return self._kept[key][1]

    def invalidate(self, index: str) -> None:
        self._kept = {k: v for k, v in self._kept.items() if index not in k[0]}


class Progress:
    """What a run tells while it goes on: its phase, how much is done of how much, the rate and the seconds left.

    Events wait in a queue of ``most``; the oldest go when a reader is too slow, so that
    no run ever waits for one.
    """

    def __init__(self, most: int = 100, every: float = 0.2, clock: Callable[[], float] = time.monotonic):
        self.every, self.clock = every, clock
        self._events: deque[dict] = deque(maxlen=most)
        self._more = threading.Condition()
        self.dropped = 0

    def publish(self, **event) -> None:
        with self._more:
            self.dropped += len(self._events) == self._events.maxlen
            self._events.append(event)
            self._more.notify_all()

    def read(self, timeout: float = 0.0) -> list[dict]:
        """All events that wait, after ``timeout`` seconds at most."""
        with self._more:
            if not self._events:
                self._more.wait(timeout)
            out = list(self._events)
            self._events.clear()
            return out

    @contextmanager
    def phase(self, name: str, total: int, done: Callable[[], int]) -> Iterator[None]:
        """Tell of ``done()`` now and then while the block runs, and of all when it ended well."""
        began, over, last = self.clock(), threading.Event(), [-1]

        def tell(count: int) -> None:
            if count > last[0]:
                last[0] = count
                rate = count / max(self.clock() - began, 1e-6)
                self.publish(phase=name, done=count, total=total, rate=rate, seconds_left=(total - count) / rate if rate else None)

        def watch() -> None:
            while not over.wait(self.every):
                tell(min(done(), total))

        tell(0)
        watcher = threading.Thread(target=watch, daemon=True)
        watcher.start()
        try:
            yield
        finally:
            over.set()
            watcher.join()
        tell(total)


class Cancelled(RuntimeError):
    """A run was ended from outside."""


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs inside carry a tag, so that ``cancel`` from another thread ends them."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.interruptTag(tag)
