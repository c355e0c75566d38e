"""Operators of a training-data pipeline: text quality, duplicates, tokens, packing, licences, pages, transcripts."""
