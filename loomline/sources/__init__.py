"""Parquet tables of a workspace: staged writes, published views, introspection."""

from .storage import Storage

__all__ = ["Storage"]
