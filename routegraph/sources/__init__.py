"""Input tables: file readers (CSV/Parquet) and the derived test-table mapping."""

from routegraph.sources.files import (
    clean_routes,
    read_airlines,
    read_airports,
    read_routes,
)

__all__ = ["clean_routes", "read_airlines", "read_airports", "read_routes"]
