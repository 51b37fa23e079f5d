"""Corpus-scale analytics of document structure, expressed as Spark DataFrames."""
