"""Registered queries over the derived tables, each with equivalent SQL."""

from . import detectors, ingest, lifecycle, reads, registry, streams

_MODULES = (registry, detectors, lifecycle, reads, ingest, streams)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
