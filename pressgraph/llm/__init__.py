"""Operators of a training-data pipeline: one module for each operator.

``queries`` holds the registered queries of these operators.
"""
