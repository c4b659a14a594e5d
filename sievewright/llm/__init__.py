"""Training-data operators: decontamination, chat formatting, sharding, language and
toxicity scoring, mixing and four kinds of deduplication.

Nothing outside this folder, its tests and ``corpus_pipeline.py`` imports it.
"""
