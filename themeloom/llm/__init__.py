"""Operators of a training-data pipeline: packing, dedup, mixing, search, language, quality, pages.

Every module holds one operator with its own general interface; ``queries``
registers them on the supplied tables. Nothing outside this folder imports it
but ``corpus_pipeline`` and the guarded part of ``__spark_entry__``.
"""
