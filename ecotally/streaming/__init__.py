"""Incremental runs of the batch jobs (the analysed scripts have no streams)."""

from .incremental import finish_units, latest_report, start_habitat_stream, unit_state

__all__ = ["finish_units", "latest_report", "start_habitat_stream", "unit_state"]
