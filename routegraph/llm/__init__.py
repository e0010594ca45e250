"""Operators for preparing large text corpora for model training.

Nothing else in the library imports this subpackage; it uses only the general session
helper of the library. ``queries.py`` registers one query per operator.
"""
