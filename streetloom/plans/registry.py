"""All registered queries by name, and their SQL."""

from . import dashboard, datasets, evaluation, places, reviews, serving  # noqa: F401  (they register)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
