"""Operators for preparing training corpora: near copies, leaks, personal data, secrets, licences, quality and more.

Every operator takes and returns DataFrames. Nothing else in the library imports this subpackage.
"""
