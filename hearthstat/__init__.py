"""Household-survey statistics as Spark DataFrame operations."""
