"""Readers and writers of alignment, annotation, sequence and table formats."""
