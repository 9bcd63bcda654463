"""Streaming: intentionally empty.

The report definitions have no event-time windows, watermarks, state or late data: each report is
re-run in full against a moving as-of date.  Runs are batch jobs keyed by ``as_of`` (see
``uwlens.sources.sinks.write_report``), so nothing here wraps Structured Streaming.
"""
