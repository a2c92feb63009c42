"""Training-data operators: deduplication, scoring, filtering, archives, mixing.

Self-contained: nothing else in the library imports this subpackage.
"""
