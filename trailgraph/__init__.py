"""Code and change analytics on Spark: a property graph held as DataFrames and
the questions asked of it (impact, callers, history, freshness, claims, gates,
retrieval and budgets)."""
