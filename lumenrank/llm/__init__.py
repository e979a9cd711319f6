"""Operators for training-data corpora: quality, privacy, secrets, counting, licences, packing and duplicates.

Each module holds one operator with its general interface and the thin query
that applies it to whole tables. Nothing else in the package imports this one.
"""
