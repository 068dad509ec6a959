"""Training-data operators: scoring, decontamination, deduplication, archives, mixing and language models.

Nothing else in the library imports this subpackage.
"""
