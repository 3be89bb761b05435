"""quarryline: Spark-native operators for measurement, geometry and corpus tables."""
