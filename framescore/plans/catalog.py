"""Every query of the library by name, with its SQL."""

from . import checks, composite, files, goldside, identity, layouts, links, reconcile, rewrites, scoring, storage, strict, summaries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
