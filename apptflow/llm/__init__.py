"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; the queries that apply
the operators to the driver's tables are in :mod:`apptflow.llm.queries`.
"""
