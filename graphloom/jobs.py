"""Jobs with priorities: run side by side on one session, each in the scheduler pool of its priority."""

from __future__ import annotations

import queue
from collections.abc import Callable
from concurrent.futures import Future
from itertools import count

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: Priorities from 1, the lowest, to 5; any above 1 counts as high.
HIGH, LOW = 5, 1


def pool(priority: int) -> str:
    return "high" if priority > LOW else "low"


class JobQueue:
    """Starts waiting jobs by priority, first come first served within one, on `workers` threads. A job is any function
    of the session; the Spark jobs that it starts are in the scheduler pool of its priority. The pools' weights are the
    cluster's (spark.scheduler.mode FAIR and its allocation file)."""

    def __init__(self, spark: SparkSession, workers: int = 2) -> None:
        self.spark = spark
        self._waiting: queue.PriorityQueue = queue.PriorityQueue()
        self._number = count()
        self._threads = [InheritableThread(target=self._work, daemon=True) for _ in range(workers)]
        self._begun = False

    def submit(self, job: Callable[[SparkSession], object], priority: int = LOW) -> Future:
        if not isinstance(priority, int) or isinstance(priority, bool) or priority < LOW:
            raise ValueError("a priority is a whole number from 1 on")
        done: Future = Future()
        self._waiting.put((-min(priority, HIGH), next(self._number), job, done))
        return done

    def start(self) -> JobQueue:
        if not self._begun:
            self._begun = True
            for t in self._threads:
                t.start()
        return self

    def stop(self) -> None:
        """Ends the threads once the jobs submitted so far are done."""
        for _ in self._threads:
            self._waiting.put((1, next(self._number), None, None))
        for t in self._threads if self._begun else ():
            t.join()

    def _work(self) -> None:
        while True:
            minus, _, job, done = self._waiting.get()
            if job is None:
                return
            if not done.set_running_or_notify_cancel():
                continue
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool(-minus))
            try:
                done.set_result(job(self.spark))
            except BaseException as e:  # the caller gets it from the future
                done.set_exception(e)
            finally:
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
