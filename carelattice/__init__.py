"""Clinic operations analytics as plain Spark DataFrame operators."""
