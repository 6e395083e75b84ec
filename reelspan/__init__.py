"""Transcript and media-timeline analytics on Spark."""
