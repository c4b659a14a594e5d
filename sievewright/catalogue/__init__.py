"""The engine's own queries over the driver's tables, with SQL that says the same."""

from . import batches, conditions, corpus, events, resumes, runs, stores
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "batches", "conditions", "corpus", "events", "resumes", "runs", "stores"]
