"""Training-data operators: deduplication, filtering, screening and mixing of text corpora.

Nothing outside this package imports it.  ``queries()`` and ``oracle_sql()`` are in ``queries.py``.
"""
