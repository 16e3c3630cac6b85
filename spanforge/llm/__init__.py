"""Training-data operators: tokenising, packing, filtering, deduplication, search.

Nothing outside this subpackage imports it.  Each module holds one operator with
a general DataFrame interface; ``queries`` registers one production query each.
"""
