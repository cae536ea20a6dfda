"""Gridded observation analytics, statistics and text-corpus operators as Spark DataFrame jobs."""
