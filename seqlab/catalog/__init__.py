"""All registered queries; importing the modules fills the registry."""

from seqlab.catalog import cleaning, features, labels, learning, metrics, sources, splits, vocabulary  # noqa: F401
from seqlab.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
