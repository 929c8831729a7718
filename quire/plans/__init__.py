"""Registered queries over the driver's tables, and their oracles."""

from . import decide, files, output, packages, scalars, sequences, stages  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
