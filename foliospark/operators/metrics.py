"""Figures of a run, counted while its rows are written."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Run:
    """``counting`` marks the rows whose writing is the run; ``figures`` tells, once they are written: documents, successes
    and failures (if ``good`` tells them apart), seconds since the run was made, documents a second."""

    def __init__(self, good: Column | None = None):
        self.good, self.began, self.seen = good, time.monotonic(), Observation()

    def counting(self, rows: DataFrame, **more: Column) -> DataFrame:
        """The same rows; ``more`` are further aggregates to observe."""
        counts = {"documents": F.count("*")}
        if self.good is not None:
            counts["successes"] = F.count_if(self.good)
        return rows.observe(self.seen, *(c.alias(name) for name, c in (counts | more).items()))

    def figures(self) -> dict:
        got, seconds = self.seen.get, time.monotonic() - self.began
        failures = {"failures": got["documents"] - got["successes"]} if "successes" in got else {}
        return got | failures | {"seconds": seconds, "documents_per_second": got["documents"] / seconds if seconds else None}
