"""What the stages of a plan and the generations of a store come to, told as they happen."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .store import Store


class Measures:
    """Rows and bytes of named stages, observed on the way of one action, and seconds of named steps of the driver.

    A stage is measured where it stands: conditions that follow it are not moved before it. Its numbers are those of the
    first action that runs it; a stage that no action has run yet has none.
    """

    def __init__(self):
        self.seen: dict[str, Observation] = {}
        self.seconds: dict[str, float] = {}

    def stage(self, name: str, df: DataFrame, size: str | None = None) -> DataFrame:
        """``df`` with its rows counted and the column ``size`` summed; nulls count as rows and as no bytes."""
        if name in self.seen:
            raise ValueError(f"a stage has this name already: {name}")
        self.seen[name] = Observation()
        total = F.lit(0) if size is None else F.coalesce(F.sum(size), F.lit(0))
        return df.observe(self.seen[name], F.count(F.lit(1)).alias("rows"), total.cast("long").alias("bytes"))

    @contextmanager
    def step(self, name: str):
        """Adds the time until the end of the block, also where it fails."""
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began

    def table(self, spark: SparkSession) -> DataFrame:
        """(stage, rows, bytes) of all stages, in the order in which they were named; to be asked for after the action."""
        rows = [(name, o.get["rows"], o.get["bytes"]) for name, o in self.seen.items()]
        return spark.createDataFrame(rows, "stage string, rows long, bytes long")


class Generations(StreamingQueryListener):
    """A listener of streams that apply their batches to a store: hands on (batch, rows, generation) after each batch, with
    the generation that readers then see. Batches that made none, as empty ones, give the one before."""

    def __init__(self, store: Store, told: Callable[[int, int, int], None], name: str | None = None):
        """``name``: that of the query to listen to, all by default."""
        self.store, self.told, self.name = store, told, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name is None or p.name == self.name:
            self.told(p.batchId, p.numInputRows, self.store.manifest()["generation"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
