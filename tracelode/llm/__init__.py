"""Operators for preparing training data at corpus scale.

Every operator takes and returns DataFrames, selects the columns it needs by name (other columns are ignored, whatever
they are called) and is total: nulls, empty tables, ties and repeated rows all have a result stated in its docstring.
"""
