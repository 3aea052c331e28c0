"""Operators for training-data pipelines: packing, near-dedup, decontamination, token
files, quality rules, language identification, secrets, sharding, toxicity, chat."""
