"""Training-data operators: sharding, quality, decontamination, dedup, mixing, rules, scans.

Each module holds one operator with its own general interface; ``queries`` derives the
registered ``opN_*`` results from them. Nothing else in the library imports this package.
"""
