"""Training-data operators: token counts, deduplication, formatting, scoring, decontamination, sharding, secret scans, whitening, runs.

Nothing else in the library imports this subpackage; ``queries`` lists what it registers.
"""
