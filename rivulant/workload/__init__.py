"""The registered queries: one operator over the shared tables, with an independent SQL check."""

from rivulant.workload.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
