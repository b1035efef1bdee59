"""Readers and writers: catalogs, feeds, raw Markdown, quotes, summaries."""
