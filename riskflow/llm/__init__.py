"""Operators of a training-data pipeline over documents and web pages, one module per operator.

Nothing outside this folder imports it. ``queries`` registers one query per operator.
"""
