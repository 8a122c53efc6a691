"""Structured Streaming: file sources, event-time aggregates with watermarks, exactly-once file sinks."""

from .events import deduplicated, event_stream, joined_within, run_available, run_complete, session_counts, windowed_counts

__all__ = ["deduplicated", "event_stream", "joined_within", "run_available", "run_complete", "session_counts", "windowed_counts"]
