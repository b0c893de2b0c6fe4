"""Structured Streaming: documents as they arrive and status events folded by micro-batch."""
