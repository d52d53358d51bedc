"""A Spark-native engine for irregular multi-band time series and their review queues."""

VERSION = "2.0.0"
