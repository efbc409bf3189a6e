"""Training-data operators: chat formatting, language-model scoring, suffix deduplication, packing, similarity join,
top-k search, language identification, source mixing, fingerprints and paragraph deduplication.

Nothing else in the library imports this subpackage.
"""
