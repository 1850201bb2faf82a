"""Work on many tables in one job, where one that fails becomes a row and the others go on."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame


def reason(e: Exception) -> str:
    """A short name of a failure: Spark's error condition, else the class of what lies at its bottom."""
    if isinstance(e, PySparkException) and e.getCondition():
        return e.getCondition()
    if isinstance(e, Py4JJavaError):
        cause = e.java_exception
        while cause.getCause() is not None:
            cause = cause.getCause()
        return cause.getClass().getSimpleName()
    return type(e).__name__


def together(job: Callable[[list], dict[Any, Any]], work: list) -> tuple[dict[Any, Any], dict[int, str]]:
    """What ``job`` finds for all of ``work`` in one go, and the reasons of what failed, by place in ``work``.

    Only if the job fails, it is done again by halves, until what fails stands alone: k failures among n cost about
    2 k log n jobs, and none costs one."""

    def part(at: list[int]) -> tuple[dict[Any, Any], dict[int, str]]:
        if not at:
            return {}, {}
        try:
            return job([work[k] for k in at]), {}
        except Exception as e:  # noqa: BLE001 - whatever a source, a driver or a callback raises is a row
            if len(at) == 1:
                return {}, {at[0]: reason(e)}
        half = len(at) // 2
        (found, failed), (more, too) = part(at[:half]), part(at[half:])
        return found | more, failed | too

    return part(list(range(len(work))))


def stacked(frames: list[DataFrame]) -> DataFrame:
    """The union of frames with the same columns in the same order, pair by pair: each step analyses its plan anew, so one
    after another would take time with the square of their number."""
    while len(frames) > 1:
        frames = [frames[k].union(frames[k + 1]) if k + 1 < len(frames) else frames[k] for k in range(0, len(frames), 2)]
    return frames[0]
