"""Operators that prepare text and vectors for language-model training.

Each module holds one operator: DataFrame in, DataFrame out. ``queries`` binds
the operators to the tables they are meant for.
"""
