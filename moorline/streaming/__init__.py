"""Structured Streaming forms of what the batch operators do on logs and scores."""
