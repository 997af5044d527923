"""Structured Streaming versions of the event-log operators."""

from .live import (  # noqa: F401
    adapter_status_stream, burst_stream, changed_files_stream, coalesce_bursts, dead_letters, fold_stream, generation_violations, impact_on_change, latest_impact_stream,
    stream_events, upsert_stream, write_dead_letters,
)
