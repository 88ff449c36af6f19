"""Operators for preparing training text at corpus scale.

Each module holds one operator with a general interface and, at its end, the
thin ``opN_*`` query that applies it to a whole table.
"""
