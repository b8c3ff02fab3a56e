"""Operators of a training-data pipeline, each a Spark job over whole tables.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries`` registers one query per operator.
"""
