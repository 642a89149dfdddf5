"""Operators of a training-data pipeline: quality, language model, rules, tokens, chat, decontamination,
toxicity, URL filters, near duplicates, web archives. Nothing else in the library imports this package."""
