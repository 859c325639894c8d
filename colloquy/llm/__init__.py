"""Operators for preparing training text: tokens, language, quality, duplicates, benchmarks, chat."""
