"""Statistics, splits, metrics and models over rows of features."""
