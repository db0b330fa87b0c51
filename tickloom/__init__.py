"""Market time series and text analytics on Spark."""
