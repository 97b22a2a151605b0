"""Operators for preparing large text, page and vector corpora.

Nothing outside this subpackage imports it.
"""
