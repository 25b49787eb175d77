"""Attestry: Spark-native preparation, retrieval, grounding and evaluation of text corpora."""

__version__ = "0.1.0"
