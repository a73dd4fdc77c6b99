"""Spark analytics over CI workflow definitions."""
