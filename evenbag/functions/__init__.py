"""Typed predicates and scalar functions, as SQL text that Spark and DuckDB both run."""
