"""Structured Streaming form of the job."""
