"""DataFrame-to-DataFrame operators over article, item and vector tables."""
