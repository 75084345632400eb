"""Operators of a training-data pipeline: filters, de-duplication, search, extraction, encoding."""
