"""Training-data operators.  Nothing outside this subpackage imports it.

Each module holds one operator with its own general interface; ``queries``
holds the thin ``opN_*`` queries that apply them to the whole tables.
"""
