"""Operators for large training corpora: text, web pages, embeddings and token ids.

Nothing outside this subpackage imports it.
"""
