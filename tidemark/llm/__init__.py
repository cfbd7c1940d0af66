"""Training-data operators (deduplication, classification, packing, privacy).

Nothing outside this subpackage imports it; the registry in ``queries.py`` is
added to ``__spark_entry__`` only when the subpackage can be imported.
"""
