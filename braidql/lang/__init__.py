"""The filter language: text to syntax tree."""

from .parser import ParseError, parse

__all__ = ["ParseError", "parse"]
