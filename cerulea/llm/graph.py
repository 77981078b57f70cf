"""Connected components of a graph held as a table of edges: the library's own."""

from cerulea.operators.graph import SALTS, components

__all__ = ["SALTS", "components"]
