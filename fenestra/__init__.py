"""Catalogue entity resolution and analytics as composable Spark DataFrame functions."""
