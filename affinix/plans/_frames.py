"""Frames that several steps of one query share: each is written once for the query, and read where it is needed."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from affinix.functions.scratch import new_folder, stored

_open: ContextVar[dict[str, DataFrame] | None] = ContextVar("frames", default=None)


@contextmanager
def frames():
    """While this is open, once() makes each frame a single time."""
    token = _open.set({})
    try:
        yield
    finally:
        _open.reset(token)


def once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), written in a new folder and read again."""
    made = _open.get()
    if made is None:
        return make()
    if name not in made:
        made[name] = stored(make(), f"{new_folder(spark)}/{name}")
    return made[name]
