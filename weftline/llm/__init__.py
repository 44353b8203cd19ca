"""Training-data operators: each module holds one operator and its ``opN_`` query.

Nothing outside this subpackage imports it, so it may be removed as a whole.
"""
