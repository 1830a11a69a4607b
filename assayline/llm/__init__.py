"""Operators for preparing text at training scale; nothing else in the library imports this."""
