"""All queries of the subpackage, by importing the modules that register them."""

from eventlens.llm import alignment, collocations, decontaminate, katz, licenses, mixing, pages, pii, quality, repeats, sharding, simhash, toxicity  # noqa: F401
from eventlens.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
