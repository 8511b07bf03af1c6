"""DataFrame to DataFrame operators of the triage job."""
