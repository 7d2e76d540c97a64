"""Cardamom: Spark-native analytics for study logs, versioned learning content and scanned-text tables."""
