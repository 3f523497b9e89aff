"""Operators for building training corpora: deduplication, archives, decontamination, filters, mixing."""
