"""Training-data operators: mixing, scans, deduplication, tokens, sharding, classifiers.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
