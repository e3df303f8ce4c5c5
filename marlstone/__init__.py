"""A declarative, Spark-native query and data-processing engine."""
