"""Searches over streams."""

from . import search

__all__ = ["search"]
