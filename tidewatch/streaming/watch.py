"""What a following query reports about itself while it runs."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(rows: DataFrame, name: str) -> DataFrame:
    """rows, which each batch counts under a name."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"))


class Watch(StreamingQueryListener):
    """Adds up what batches have counted, and turns the end of a query into a line: its error as a warning, or that it has stopped."""

    def __init__(self):
        self.counted: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in (event.progress.observedMetrics or {}).items():
            for k, n in row.asDict().items():
                self.counted[f"{name}.{k}"] = self.counted.get(f"{name}.{k}", 0) + (n or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            print(f"warning: {event.exception.splitlines()[0]}", file=sys.stderr)
        print(f"Stopped watching. {self.counted.get('events.rows', 0)} failed login(s) in {self.counted.get('lines.rows', 0)} line(s).", file=sys.stderr)
