"""Readers of files, catalogues and adapters."""
