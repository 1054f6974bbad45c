"""Searches, index tables, traces and reports."""

from . import approx, exact, index, multi, payload, report, suffixes, trace

__all__ = ["approx", "exact", "index", "multi", "payload", "report", "suffixes", "trace"]
