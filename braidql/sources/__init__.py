"""Sources and sinks."""

from .files import convert, inspect, load, merge, save, sniff, validate
from .formats import FORMATS, format_of

__all__ = ["FORMATS", "convert", "format_of", "inspect", "load", "merge", "save", "sniff", "validate"]
