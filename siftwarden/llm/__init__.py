"""Operators for model prompts, answers and corpora; nothing else in the library imports this."""
