"""Operators of a training-data pipeline: de-duplication, extraction, language, toxicity, licences, formats, packing."""
