"""Connected components, from the library's graph operators."""

from ..operators.graph import components, forest, star

__all__ = ["components", "forest", "star"]
