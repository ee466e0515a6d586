"""Independent parts of a job, run side by side: one small Spark job after the other would leave most cores idle."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from ..operators.ordered import use_checkpoints

AT_ONCE = 6


def one(name: str, report, *args, **kwargs):
    """A group of one report, built when the group is called."""
    return lambda: {name: report(*args, **kwargs)}


def together(spark: SparkSession, parts: list[Callable], at_once: int = AT_ONCE) -> list:
    """The results of the functions, in their order. At most `at_once` run at a time; the first to fail, in that order, raises, after
    those that have begun are done, and no further one is begun. Each has the caller's local properties."""
    use_checkpoints(spark)                                       # one folder, set before the threads ask for it
    with ThreadPoolExecutor(at_once) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(p)) for p in parts]
        try:
            return [b.result() for b in begun]
        finally:
            for b in begun:
                b.cancel()
