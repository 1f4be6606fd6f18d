"""Training-data operators: dedup, decontamination, packing, sharding and friends.

Nothing outside this subpackage imports it.  Every module keeps a general
operator (real outputs: ids, spans, files) and ``registry`` holds the thin
``opN_*`` queries that derive digest columns from them.
"""
