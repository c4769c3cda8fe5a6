"""Queries over the given tables, each with the SQL it must agree with."""

from fleetwear.catalog import explore, features, modelling, storage, upkeep
from fleetwear.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "explore", "features", "modelling", "storage", "upkeep"]
