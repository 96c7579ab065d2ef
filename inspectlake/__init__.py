"""Spark-native analytics for fleets of surface-inspection stations."""
