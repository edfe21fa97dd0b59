"""Counters of rows while they pass: no job of their own, in batches and in streams.

``watched`` adds named counters to a plan.  A batch job gives them through its ``Observation`` once its rows
are written; each micro-batch of a stream reports them in its progress, together with the rows that a
watermark or a deduplication dropped.  ``Progress`` gathers the latter for streams that run for long, since a
query itself remembers its last reports only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

# fixed values: what becomes of a transcript line
TRACE_DISPOSITIONS = ("accepted", "foreign", "lost", "malformed", "out_of_order", "unsupported")


def counters_of(column: str, values: Iterable[str]) -> dict[str, Column]:
    """One counter per value of ``column``, and ``rows``."""
    return {"rows": F.count(F.lit(1))} | {v: F.count_if(F.col(column) == v) for v in values}


def watched(rows: DataFrame, counters: dict[str, Column], name: str = "counters") -> tuple[DataFrame, Observation | None]:
    """``rows`` with ``counters`` on the way; the observation of a batch (None for a stream, see ``batch_counts``).

    The rows must be read by one action only, since a second one would be counted anew.
    """
    columns = [c.alias(n) for n, c in counters.items()]
    if rows.isStreaming:
        return rows.observe(name, *columns), None
    observation = Observation(name)
    return rows.observe(observation, *columns), observation


def batch_counts(progress, name: str = "counters") -> dict[str, int]:
    """Counters of one micro-batch: those of ``watched``, ``late`` rows behind a watermark and dropped ``duplicate`` ones."""
    metrics = progress.observedMetrics
    row = metrics[name] if name in metrics else None
    counts = {} if row is None else {k: int(v or 0) for k, v in (row.asDict() if hasattr(row, "asDict") else dict(row)).items()}
    states = progress.stateOperators
    counts["late"] = sum(int(s.numRowsDroppedByWatermark) for s in states)
    counts["duplicate"] = sum(int((s.customMetrics or {}).get("numDroppedDuplicateRows", 0)) for s in states)
    return counts


class Progress(StreamingQueryListener):
    """Counters of every micro-batch of the queries called ``query`` (all queries if none is named).

    ``spark.streams.addListener(listener)`` starts it.  A batch that is run again replaces its counters.
    """

    def __init__(self, name: str = "counters", query: str | None = None):
        self.name, self.query = name, query
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802 - the interface's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if self.query is None or p.name == self.query:
            self.batches[str(p.id), int(p.batchId)] = batch_counts(p, self.name)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def totals(self) -> dict[str, int]:
        """Sums over all batches."""
        out: dict[str, int] = {}
        for counts in self.batches.values():
            for k, v in counts.items():
                out[k] = out.get(k, 0) + v
        return out
