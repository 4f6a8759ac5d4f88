"""Spend and usage analytics over AI coding-assistant logs, as Spark DataFrames."""
