"""Metrics of streaming queries, in the text form that metric collectors read."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

_HELP = {"rows": "input rows of the last batch", "rows_per_second": "input rows a second", "processed_per_second": "rows processed a second", "batch": "number of the last batch", "state_rows": "rows of state"}


def exposition(values: dict[str, float], labels: dict[str, str]) -> str:
    """Lines `stream_<name>{label="value"} number` with their help."""
    quoted = {k: str(v).replace("\\", r"\\").replace('"', r"\"").replace("\n", r"\n") for k, v in labels.items()}
    shown = ",".join(f'{k}="{v}"' for k, v in quoted.items())
    return "".join(f"# HELP stream_{k} {_HELP.get(k, k)}\n# TYPE stream_{k} gauge\nstream_{k}{{{shown}}} {v:g}\n" for k, v in values.items())


def push_to(url: str, timeout: float = 5.0) -> Callable[[str], None]:
    """A sink that puts the lines to a gateway."""

    def push(text: str) -> None:
        urllib.request.urlopen(urllib.request.Request(url, text.encode(), method="PUT"), timeout=timeout).close()

    return push


class Metrics(StreamingQueryListener):
    """Gives every progress report of the session's streaming queries to `sink` as text. A sink that fails does not
    stop a query; its failures are counted. Register with spark.streams.addListener()."""

    def __init__(self, sink: Callable[[str], None]) -> None:
        self.sink, self.failures, self.ended = sink, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        number = lambda x: float(x) if x is not None and x == x else 0.0
        values = {"batch": number(p.batchId), "rows": number(p.numInputRows), "rows_per_second": number(p.inputRowsPerSecond), "processed_per_second": number(p.processedRowsPerSecond), "state_rows": float(sum(s.numRowsTotal for s in p.stateOperators))}
        try:
            self.sink(exposition(values, {"query": p.name or str(p.id)}))
        except Exception:
            self.failures += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1
