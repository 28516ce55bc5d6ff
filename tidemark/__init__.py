"""tidemark: analytics over tidy personal time series, on Spark."""
