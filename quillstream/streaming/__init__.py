"""Streaming forms of ingest and conversation state (an addition of this engine)."""
