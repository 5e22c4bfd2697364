"""Column functions: histograms, uncertain values and texts."""
