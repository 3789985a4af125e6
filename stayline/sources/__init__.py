"""Readers and writers: raw extracts, tables, documents, images and model bundles."""
