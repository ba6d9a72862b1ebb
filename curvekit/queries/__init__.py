"""Registered queries and the SQL that gives the same rows on the driver tables."""
from . import atrisk, axis, checks, clean, joins, pixels, quality, runs, text, views  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
