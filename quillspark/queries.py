"""All queries of the package, by name, and their SQL."""

from importlib import import_module

from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

for _name in ("search", "scalars", "documents", "dialog", "relational", "quality", "structured", "services", "records", "catalog", "sessions", "indexing", "files", "near", "pages", "statements", "handlers", "parents"):
    import_module(f"quillspark.plans.{_name}")
