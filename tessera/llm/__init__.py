"""Operators for large-scale training-data preparation.

Every operator takes a DataFrame and the names of its id and text columns,
reads only those columns (so that other columns may have any name), treats a
null text as the empty text and returns one row per input row unless its
docstring says otherwise.
"""
