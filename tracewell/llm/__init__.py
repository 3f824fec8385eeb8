"""Operators for large training corpora.

Nothing else in the library imports this subpackage.  Every operator module has
a general function over DataFrames and keeps its own ``query`` function, which
applies it to the whole intended table; :mod:`tracewell.llm.catalogue` lists
the queries and the SQL they are held against.
"""
