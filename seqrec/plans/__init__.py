"""End-to-end recommender plans built from the operators (lazy DataFrames)."""
