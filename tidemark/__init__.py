"""Product KPIs, community signals and query evaluation as PySpark DataFrame operators."""
