"""Operators for training data: groups of matches, entity matching, survivors, tokens, packing and garbled text.

Nothing outside this folder imports it.
"""
