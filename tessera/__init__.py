"""Tessera: a Spark-native select-project-join-orderby engine."""
