"""Searches that can be ended from another thread."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


class Cancelled(Exception):
    """The search was ended before it was done."""


class Cancellation:
    """Ends what runs under it; other work of the session goes on.

    ``run`` works with a tag of its own on the jobs that a thread starts, so that ``cancel`` ends just those, running or
    waiting, on all executors.  What has been cancelled stays so.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tag, self.ended = spark, f"search-{uuid.uuid4().hex}", threading.Event()

    @property
    def cancelled(self) -> bool:
        return self.ended.is_set()

    def cancel(self) -> None:
        self.ended.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self, action: Callable[[], T]) -> T:
        """The result of an action such as ``found.collect``."""
        if self.cancelled:
            raise Cancelled(self.tag)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            return action()
        except Exception as error:
            if self.cancelled:
                raise Cancelled(self.tag) from error
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
