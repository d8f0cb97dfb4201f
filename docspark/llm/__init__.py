"""Training-data operators: filtering, deduplication, decontamination, packing and formatting.

Nothing else in the library imports this subpackage.  Each module holds one operator with a
general interface; ``queries.py`` holds the thin ``opN_<name>`` queries and their SQL.
"""
