"""Readers and writers for the file forms that the pipelines meet."""
