"""Registry of the algorithms, measurement, and the catalogue of queries."""

from . import measure, registry

__all__ = ["measure", "registry"]
