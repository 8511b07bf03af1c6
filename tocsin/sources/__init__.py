"""Readers and writers of requests, dumps, rules and reports."""
