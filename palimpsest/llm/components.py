"""Connected components of an edge table: those of the library, under this subpackage's name."""

from palimpsest.operators.components import components, merged

__all__ = ["components", "merged"]
