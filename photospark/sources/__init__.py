"""Readers and writers: series archives, catalogues, result files, published output."""
