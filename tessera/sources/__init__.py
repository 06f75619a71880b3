"""Readers and writers of files, crawled pages and decision lines."""
