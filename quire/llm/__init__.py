"""Operators for preparing training text, each a DataFrame-to-DataFrame function.

``queries`` holds the thin registered queries; every other module is one
operator with its own general interface.
"""
