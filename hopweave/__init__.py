"""hopweave: PySpark-native analytics for knowledge-graph question answering data."""
