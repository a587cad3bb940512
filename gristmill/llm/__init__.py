"""Training-data operators: sharding, de-duplication, tokenizing, packing, search and audits.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` derives the registered queries.
"""
