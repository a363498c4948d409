"""Operators of a large-scale training-data pipeline, on top of PySpark only.

Nothing outside this subpackage imports it.  Each module holds one operator (or one
operator and the general pieces it is made of); ``queries`` registers the thin
``opN_<name>`` queries.
"""
