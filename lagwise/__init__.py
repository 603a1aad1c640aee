"""Discovery of lagged relationships between time series, on Spark."""
