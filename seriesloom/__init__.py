"""Panel time-series diagnosis and forecasting on Spark."""
