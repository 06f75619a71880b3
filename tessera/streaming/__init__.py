"""Stages over arriving files."""
