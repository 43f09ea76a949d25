"""Marlstone: analytics over source and text corpora, planned by Spark."""
