"""Training-data operators: text, pages and vectors as Spark DataFrames.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
