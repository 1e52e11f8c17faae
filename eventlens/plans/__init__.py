"""Named queries over the test tables and their SQL checks."""

from eventlens.plans import attribution, distribution, growth, inputs, series, sketches, stats, text, vectors  # noqa: F401
from eventlens.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
