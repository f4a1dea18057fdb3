"""Relational analytics over integer tables on Spark: operators, ring arithmetic, and a small SQL surface."""
