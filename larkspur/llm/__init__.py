"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  ``larkspur.llm.queries`` holds the
thin ``opN_<name>`` queries over the driver tables and their SQL.
"""
