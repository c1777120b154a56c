"""Operators for building text training corpora at scale.

Each module holds one operator with its own general interface, and the thin
query that applies it to the whole `documents` table with production
parameters. Nothing outside this package imports it.
"""
