"""Cutting lineage in storage that all executors share."""

from tidelane.storage import Tables, dropped_after, shared_folder

__all__ = ["Tables", "dropped_after", "shared_folder"]
