"""Tables that change underneath: read again every time, or keep a snapshot for a while."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyward.session import checkpoint_root

# Refresh modes, default time to live and the number of snapshots kept.
MODES = ("always", "ttl")
TTL_SECONDS = 30
MAX_SNAPSHOTS = 200


class LiveTable:
    """Frames of a live source under a refresh policy.

    `read` makes a frame from the source, given an optional query or condition as its key. In `always` mode it
    is called for every frame. In `ttl` mode the frame is checkpointed and handed out until it is older than the
    time to live; the oldest of more than MAX_SNAPSHOTS frames is dropped. A checkpoint lies in the shared folder,
    so a lost executor does not make part of a snapshot anew from a source that has moved on; Spark removes the
    files of dropped frames when spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """

    def __init__(
        self,
        read: Callable[[str | None], DataFrame],
        mode: str = "ttl",
        ttl_seconds: float = TTL_SECONDS,
        clock: Callable[[], float] = time.monotonic,
    ) -> None:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self._read, self.mode, self._ttl, self._clock = read, mode, ttl_seconds, clock
        self._snapshots: OrderedDict[str | None, tuple[float, DataFrame]] = OrderedDict()
        self._lock = threading.Lock()

    def frame(self, key: str | None = None) -> DataFrame:
        """The current frame for a key."""
        if self.mode == "always":
            return self._read(key)
        with self._lock:
            now = self._clock()
            made, frame = self._snapshots.get(key, (None, None))
            if frame is not None and now - made < self._ttl:
                return frame
            fresh = _snapshot(self._read(key))
            self._snapshots[key] = (now, fresh)
            self._snapshots.move_to_end(key)
            while len(self._snapshots) > MAX_SNAPSHOTS:
                self._snapshots.popitem(last=False)
            return fresh

    def clear(self) -> None:
        """Drop every snapshot."""
        with self._lock:
            self._snapshots.clear()


def _snapshot(frame: DataFrame) -> DataFrame:
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(frame.sparkSession))
    return frame.checkpoint()


def live_files(spark: SparkSession, path: str, mode: str = "always", ttl_seconds: float = TTL_SECONDS, file_format: str = "parquet") -> LiveTable:
    """A growing folder: every fresh frame lists its files again."""

    def read(_: str | None) -> DataFrame:
        spark.catalog.refreshByPath(path)
        return spark.read.format(file_format).load(path)

    return LiveTable(read, mode, ttl_seconds)
