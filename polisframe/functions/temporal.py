"""Validity in time on either axis: ``database`` (creation to termination) or ``real_world`` (valid from to valid to)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from polisframe.model import ModelError

AXES = {"database": ("creation_date", "termination_date"), "real_world": ("valid_from", "valid_to")}


def _axis(reference: str) -> tuple[Column, Column]:
    if reference not in AXES:
        raise ModelError(f"unknown validity reference {reference!r}")
    start, end = AXES[reference]
    return F.col(start), F.col(end)


def _at(timestamp) -> Column:
    return F.lit(timestamp) if isinstance(timestamp, (str, dt.date)) else timestamp


def valid(reference: str = "database") -> Column:
    return _axis(reference)[1].isNull()


def valid_at(timestamp, reference: str = "database", lenient: bool = False) -> Column:
    """Valid at an instant: from <= t < to. ``lenient`` accepts rows without a start."""
    start, end = _axis(reference)
    at = _at(timestamp).cast("timestamp")
    started = start <= at
    if lenient:
        started = started | start.isNull()
    return started & (end.isNull() | (end > at))


def invalid(reference: str = "database") -> Column:
    return _axis(reference)[1].isNotNull()


def invalid_at(timestamp, reference: str = "database") -> Column:
    return _axis(reference)[1] <= _at(timestamp).cast("timestamp")


def validity(mode: str = "valid", at=None, reference: str = "database", lenient: bool = False) -> Column | None:
    """The filter for a mode; the default keeps what is valid in the database, ``all`` filters nothing."""
    if mode == "all":
        return None
    if mode == "valid":
        return valid(reference) if at is None else valid_at(at, reference, lenient)
    if mode == "invalid":
        return invalid(reference) if at is None else invalid_at(at, reference)
    raise ModelError(f"unknown validity mode {mode!r}")
