"""DataFrame-in, DataFrame-out operators on panels of time series."""
