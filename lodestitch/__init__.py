"""Spark-native record synthesis: landed sources in, linked entity tables out."""
