"""Type names."""

from .types import parse_type, schema_of

__all__ = ["parse_type", "schema_of"]
