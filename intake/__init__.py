"""Spark jobs for large-scale intake of scanned forms and of text corpora."""
