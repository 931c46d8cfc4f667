"""Composed pipelines and the registered query catalogue."""
