"""Operators for preparing training data: scoring, de-duplication, language,
mixing, tokenizing and search. Nothing outside this subpackage imports it."""
