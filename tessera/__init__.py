"""Tessera: turning collected documents into reviewed, traceable corpora on Spark."""
