"""A Spark-native analytics engine for event-camera streams."""
