"""Builtin functions of the filter language as Column builders."""

from . import aggregates, arrays, dates, encoding, finance, maths, objects, strings, urls  # noqa: F401  they register themselves
from .registry import REGISTRY, Typed, call, register

__all__ = ["REGISTRY", "Typed", "call", "register"]
