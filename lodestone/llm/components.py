"""Connected components of documents: the library's star contraction."""

from ..operators.components import star_forest as connected_components

__all__ = ["connected_components"]
