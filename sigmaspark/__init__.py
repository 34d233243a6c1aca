"""Radar scene analytics as Spark DataFrame operators."""
