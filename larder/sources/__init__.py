"""Readers and writers of tables, line files and summaries."""
