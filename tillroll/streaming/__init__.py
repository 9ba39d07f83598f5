"""Structured Streaming: uploads arriving as files, processed per micro-batch."""
