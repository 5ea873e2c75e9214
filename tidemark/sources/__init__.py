"""Benchmark sets, tracking tables and query suites."""
