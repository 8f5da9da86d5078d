"""DataFrame -> DataFrame operators (positions, sampling, splits, profiling, features, heads)."""
