"""Streaming forms of the log's operators; each has a batch form that gives the same rows."""
