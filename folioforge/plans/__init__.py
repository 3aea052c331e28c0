"""Compositions: retrieval pipelines, ablations and evaluation plans."""
