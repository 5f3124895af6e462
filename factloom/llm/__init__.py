"""Operators that prepare text for model training.

Each module holds one operator with a general interface and a thin
``query(spark, sf_dir)`` that applies it to its whole table.  Nothing outside this
subpackage imports it.
"""
