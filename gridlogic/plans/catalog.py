"""Every query by name, and the DuckDB SQL it is compared with."""

from __future__ import annotations

from gridlogic.plans import evaluation_queries, flow_queries, graph_queries, layout_queries, run_queries, score_queries, text_queries
from gridlogic.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation_queries", "flow_queries", "graph_queries", "layout_queries", "run_queries", "score_queries", "text_queries"]
