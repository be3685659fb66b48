"""kilnworks: a Spark-native engine for process time series and their evidence."""
