"""Composed reports: KPIs, community signals, evaluation, tracking, models, mining."""
