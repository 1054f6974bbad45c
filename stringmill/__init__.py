"""Exact and approximate pattern matching over collections of texts, on Spark.

The searches by name, the call that runs them, and the index that is built once::

    from stringmill import search, suffix_index, by_index
"""

from .functions.tables import register, register_search
from .operators.approx import edit_search, edit_search_bits, edit_search_first_length, edit_search_greedy, hamming_search, within
from .operators.exact import absent, by_bits, by_find, by_hash, by_index, by_split, by_suffixes, by_windows, holding, in_pieces, present, suffix_index
from .plans.measure import results
from .plans.registry import ALL, APPROXIMATE, EXACT, algorithms, search

__all__ = [
    "ALL", "APPROXIMATE", "EXACT", "absent", "algorithms", "by_bits", "by_find", "by_hash", "by_index", "by_split", "by_suffixes", "by_windows", "edit_search",
    "edit_search_bits", "edit_search_first_length", "edit_search_greedy", "hamming_search", "holding", "in_pieces", "present", "register", "register_search", "results", "search", "suffix_index", "within",
]
