"""All registered queries and their SQL twins."""

from pairloom.plans import files, models, pairs, registry, tensors  # noqa: F401

QUERIES = registry.QUERIES
# Put together once all named sub-queries are known.
ORACLES = {name: registry.with_ctes(sql) for name, sql in registry.ORACLES.items()}

__all__ = ["ORACLES", "QUERIES"]
