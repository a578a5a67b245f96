"""formatpulse: a Spark-native engine that finds content formats on the rise."""
