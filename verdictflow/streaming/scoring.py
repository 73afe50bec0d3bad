"""Scores of a stream that carry the version of the model that made them, through swaps of the model while the stream runs.

Each micro-batch asks for the model: its source looks at the pointer table once an interval (more seldom while it stands in for a version that
could not be loaded) and loads a newer version; one that fails to load leaves the old one in place. A batch that was encoded for a version
which was then swapped is encoded anew before it is scored, so encoding and scores never mix versions. Batches are written by id and
overwritten if they come again after a failure, so each row has one answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

INTERVAL, FALLBACK_INTERVAL = 10.0, 60.0


@dataclass(frozen=True)
class Model:
    version: str
    encode: Callable[[DataFrame], DataFrame]
    score: Callable[[DataFrame], DataFrame]


@dataclass
class ModelSource:
    """``pointer`` tells the newest version (null: none), ``load`` makes a model of it and fails if it cannot be used."""

    pointer: Callable[[], str | None]
    load: Callable[[str], Model]
    interval: float = INTERVAL
    fallback_interval: float = FALLBACK_INTERVAL
    clock: Callable[[], float] = time.monotonic
    model: Model | None = None
    failed: dict[str, str] = field(default_factory=dict)
    asked: float | None = None
    newest: str | None = None

    def behind(self) -> bool:
        return self.model is None or self.newest != self.model.version

    def current(self) -> Model:
        """The model to use now. A LookupError if none could be loaded yet."""
        now = self.clock()
        if self.asked is None or now - self.asked >= (self.fallback_interval if self.behind() else self.interval):
            self.asked = now
            try:
                self.newest = self.pointer()
                if self.newest is not None and self.behind():
                    self.model = self.load(self.newest)
            except Exception as e:  # whatever a broken version raises: the old one goes on
                self.failed[str(self.newest)] = f"{type(e).__name__}: {e}"
        if self.model is None:
            raise LookupError(f"no model could be loaded: {self.failed}")
        return self.model


def score_batch(rows: DataFrame, models: ModelSource) -> DataFrame:
    """The scores of ``rows`` with ``model_version``; encoded again if the model was swapped meanwhile."""
    model = models.current()
    encoded = model.encode(rows)
    while (now := models.current()) is not model:
        model, encoded = now, now.encode(rows)
    return model.score(encoded).withColumn("model_version", F.lit(model.version))


def stream_scores(
    stream: DataFrame, models: ModelSource, path: str, checkpoint: str, after: Callable[[int], None] | None = None, available_now: bool = True
) -> StreamingQuery:
    """Start scoring ``stream`` into Parquet under ``path``, a folder for each micro-batch. ``after`` is called with the id of each batch once
    its scores are written. The stream ends with what is there now, or else goes on until it is stopped."""

    def write(batch: DataFrame, number: int) -> None:
        score_batch(batch, models).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after is not None:
            after(number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
