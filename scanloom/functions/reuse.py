"""Columns that are built of many small parts, built once per Spark application."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark import SparkContext


def built_once(build: Callable) -> Callable:
    """A column only describes a computation, so every plan may use the same object; arguments must be hashable."""

    @lru_cache(maxsize=64)
    def of(application: str, args: tuple):
        return build(*args)

    @wraps(build)
    def reuse(*args):
        return of(SparkContext.getOrCreate().applicationId, args)

    return reuse
