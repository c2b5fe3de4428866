"""Requests that run beside the caller: a list of them, their progress, and cancelling."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


class Jobs:
    """Every job runs in its own thread under a Spark job group of its name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jobs: dict[str, tuple[str, float, Future]] = {}

    def start(self, what: str, f: Callable[[], object]) -> str:
        """Run f and return the job's key."""
        import threading

        key, done = f"job-{uuid.uuid4().hex[:12]}", Future()

        def run() -> None:
            self.spark.sparkContext.setJobGroup(key, what, interruptOnCancel=True)
            try:
                done.set_result(f())
            except BaseException as e:  # noqa: BLE001  the caller gets it from result()
                done.set_exception(e)

        self._jobs[key] = what, time.time(), done
        threading.Thread(target=inheritable_thread_target(self.spark)(run), daemon=True).start()
        return key

    def list(self) -> list[dict]:
        """key, description, start, state (running, done, failed) and progress of each job, the latest first."""
        out = []
        for key, (what, began, done) in reversed(self._jobs.items()):
            state = "running" if not done.done() else "failed" if done.exception() else "done"
            out.append({"key": key, "description": what, "start": began, "state": state, "progress": self.progress(key)})
        return out

    def progress(self, key: str) -> float:
        """The share of the tasks known so far that have ended; 1 for a job that is over."""
        if self._jobs[key][2].done():
            return 1.0
        tracker, tasks, ended = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(key):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    tasks, ended = tasks + s.numTasks, ended + s.numCompletedTasks
        return min(ended / tasks, 0.99) if tasks else 0.0

    def cancel(self, key: str) -> None:
        """Stop the Spark jobs of a job; its result is then an error."""
        self.spark.sparkContext.cancelJobGroup(key)

    def result(self, key: str, timeout: float | None = None) -> object:
        return self._jobs[key][2].result(timeout)

    def remove(self, key: str) -> None:
        """Forget a job that is over."""
        if not self._jobs[key][2].done():
            raise ValueError("the job still runs")
        del self._jobs[key]
