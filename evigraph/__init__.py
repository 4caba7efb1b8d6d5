"""A Spark-native analytics engine for evidence-carrying graphs of source code."""
