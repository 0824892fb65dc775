"""Citation analytics on Spark: spans, lookups, scoring, and (in ``llm``) training-data operators."""
