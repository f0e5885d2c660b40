"""Event- and interval-native analytics, expressed over Spark DataFrames."""
