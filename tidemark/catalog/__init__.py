"""Importing this package registers every query."""

import importlib

for _name in ("filter_queries", "join_queries", "aggregate_queries", "window_queries", "function_queries", "kpi_queries", "social_queries", "evaluation_queries", "source_queries", "tracking_queries", "model_queries", "mining_queries"):
    importlib.import_module(f"tidemark.catalog.{_name}")
