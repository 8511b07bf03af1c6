"""Incident triage over tables and streams of logs, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
