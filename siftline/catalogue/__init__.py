"""All registered queries."""

from . import cascade, columns, evidence, metrics, models, quality, scalars, sources, temporal  # noqa: F401
from .base import ORACLES, QUERIES


def registered():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
