"""Operators of a training-data pipeline: mixing, chat formatting, token counts and files, decontamination, language
identification, main-text extraction, fingerprints, near-duplicate groups and quality scores."""
