"""Compilation of filters to DataFrame plans."""

from .compiler import compile_filter

__all__ = ["compile_filter"]
