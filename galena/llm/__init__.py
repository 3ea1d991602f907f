"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; its queries and their
oracle SQL are in :mod:`galena.llm.queries`.
"""
