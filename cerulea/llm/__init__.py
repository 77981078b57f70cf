"""Operators for large-scale training-data pipelines, one module each.

Nothing outside this subpackage imports it. ``cerulea.llm.registry`` holds the queries and their SQL.
"""
