"""Operators of a training-data pipeline: jobs over a `documents` or an `embeddings` table.

Each module has the operator with its own interface; `contract` turns their outputs into the
registered queries.
"""
