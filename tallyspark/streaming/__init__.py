"""Structured Streaming twins of the event rules. Watermarks are parameters; every folder is the caller's."""
