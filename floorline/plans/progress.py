"""How far running work has come, told to a function while it runs."""

from __future__ import annotations

import threading
from collections.abc import Callable
from types import TracebackType

from pyspark.sql import SparkSession


class Progress:
    """``with Progress(spark, tell): ...`` calls ``tell(done, total)`` with the tasks of all active stages, at most every ``seconds``.

    The last call has done = total, whether or not there was anything to do. What ``tell`` raises ends the reports, not the work.
    """

    def __init__(self, spark: SparkSession, tell: Callable[[int, int], None], seconds: float = 0.5):
        self.tracker, self.tell, self.seconds = spark.sparkContext.statusTracker(), tell, seconds
        self.over = threading.Event()
        self.most = 0
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def now(self) -> tuple[int, int]:
        infos = [i for i in map(self.tracker.getStageInfo, self.tracker.getActiveStageIds()) if i is not None]
        return sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos)

    def _watch(self) -> None:
        while not self.over.wait(self.seconds):
            done, total = self.now()
            if total:
                self.most = max(self.most, total)
                self.tell(done, total)

    def __enter__(self) -> Progress:
        self.thread.start()
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.over.set()
        self.thread.join()
        if kind is None:
            self.tell(self.most, self.most)
