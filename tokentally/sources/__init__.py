"""Readers of log files and tables, and writers of results."""
