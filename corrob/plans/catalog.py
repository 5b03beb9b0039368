"""All queries of the library; importing this registers them."""

from corrob.plans import aggregate_queries, fusion_queries, gate_queries, ingest_queries, scalar_queries, series_queries, triangulation_queries
from corrob.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "aggregate_queries", "fusion_queries", "gate_queries", "ingest_queries", "scalar_queries", "series_queries", "triangulation_queries"]
