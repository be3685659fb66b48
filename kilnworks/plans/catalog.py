"""All registered queries: importing the modules registers them."""

from __future__ import annotations

from . import models, process, runs, standardise, statistics, streams, text_search  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
