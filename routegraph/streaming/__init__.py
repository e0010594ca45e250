"""Streams of events: the batch functions of the library, run over file-source streams."""

from routegraph.streaming.windows import closed_windows, drained, event_stream, windowed_counts

__all__ = ["closed_windows", "drained", "event_stream", "windowed_counts"]
