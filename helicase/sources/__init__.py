"""Readers and writers for sequencing formats."""
