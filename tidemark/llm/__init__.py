"""Operators for building training corpora from documents and web pages.

Nothing else in ``tidemark`` imports this subpackage.
"""
