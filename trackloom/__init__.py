"""Flight-track analytics on Spark: sources, operators, functions, plans and streaming forms."""
