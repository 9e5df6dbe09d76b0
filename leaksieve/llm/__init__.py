"""Operators for preparing large text corpora as training data.

Every operator takes and returns DataFrames, works on whole texts, and keeps no
row out to escape skew. Nothing else in the library imports this subpackage.
"""
