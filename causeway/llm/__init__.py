"""Operators of a training-data pipeline over the text tables.

Each module holds one operator with a general interface plus the thin registered query
that binds it to the driver tables; ``queries`` gathers them.  Nothing outside this
subpackage imports it.
"""
