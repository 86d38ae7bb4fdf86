"""Structured Streaming: resumable page work and keyed title history."""
