"""A batch loop that can be stopped anywhere: windows of items from the first that isn't done, until nothing is left.

Results are merged into a keyed table, one commit for each window, so results and progress are the same thing: after a lost
driver the next run goes on where the last commit was.  A window whose items fail again and again ends the loop.  One driver
at a time works: it holds a lease that it renews with each window, and that another may take once it has run out.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import runs
from skein.sources.keyed import KeyedTable, Lost

#: Windows in a row without progress that end the loop, and seconds that a lease holds.
STALLED = 3
LEASE_SECONDS = 3600


class Held(RuntimeError):
    """Another driver holds the lease."""


class Lease:
    """Numbered files of which the newest counts; each names its owner and how long it holds."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = LEASE_SECONDS, clock: Callable[[], float] = time.time):
        self.path, self.seconds, self.clock, self.owner = path.rstrip("/"), seconds, clock, uuid.uuid4().hex
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._spark = spark

    def _newest(self) -> tuple[int, dict]:
        at = self._at(self.path)
        numbers = [int(s.getPath().getName()) for s in self._files.listStatus(at) if s.getPath().getName().isdigit()] if self._files.exists(at) else []
        if not numbers:
            return 0, {"owner": None, "until": 0.0}
        return max(numbers), json.loads(self._spark.read.text(f"{self.path}/{max(numbers):08d}", wholetext=True).first()[0])

    def hold(self, seconds: float | None = None) -> None:
        """Takes or renews the lease; raises Held while it is another's."""
        number, now = self._newest()
        if now["owner"] != self.owner and now["until"] > self.clock():
            raise Held(f"{self.path}: held by {now['owner']}")
        draft = self._at(f"{self.path}/.{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps({"owner": self.owner, "until": self.clock() + (self.seconds if seconds is None else seconds)}).encode()))
        out.close()
        to = self._at(f"{self.path}/{number + 1:08d}")
        if self._files.exists(to) or not self._files.rename(draft, to):
            self._files.delete(draft, False)
            raise Held(f"{self.path}: another driver was first")

    def free(self) -> None:
        self.hold(seconds=0)


@dataclass
class Report:
    """Windows that ran, items done, and whether the loop ended because it stalled."""

    windows: int
    done: int
    stalled: bool


def worked_off(items: DataFrame, table: KeyedTable, work: Callable[[DataFrame], DataFrame], size: int, lease: Lease) -> Report:
    """Applies work to windows of `size` items from the first that isn't ok, and merges what it returns.

    items: idx from 0 without gaps, and any columns; table: key idx, with status; work gives a row with idx and status for each
    item, of which the ok ones are done.  Items of a window that are done are not given to work again.
    """
    windows = stalled = 0
    total = items.count()
    lease.hold()
    try:
        while True:
            done = table.read().where("status = 'ok'").select("idx")
            first = runs.next_index(done, "idx").first()[0]
            if first >= total or stalled >= STALLED:
                return Report(windows, done.count(), first < total)
            window = items.where((F.col("idx") >= first) & (F.col("idx") < first + size)).join(done, "idx", "left_anti")
            lease.hold()
            try:
                table.merge(work(window), f"window-{first}-{uuid.uuid4().hex}")
            except Lost as lost:
                raise Held(str(lost)) from lost
            windows += 1
            again = runs.next_index(table.read().where("status = 'ok'").select("idx"), "idx").first()[0]
            stalled = 0 if again > first else stalled + 1
    finally:
        lease.free()
