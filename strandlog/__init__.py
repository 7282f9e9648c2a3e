"""A Spark-native analytics engine for append-only event logs."""
