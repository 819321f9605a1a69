"""File formats: names, endings, how Spark reads and writes them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

# Separators of ASCII-delimited text.
UNIT, RECORD = "\x1f", "\x1e"


@dataclass(frozen=True)
class Format:
    name: str
    endings: tuple[str, ...]
    source: str | None
    options: dict[str, Any] = field(default_factory=dict)
    writes: bool = True


FORMATS = {
    f.name: f
    for f in (
        Format("csv", ("csv",), "csv", {"header": True, "inferSchema": True, "escape": '"', "multiLine": False}),
        Format("tsv", ("tsv",), "csv", {"header": True, "inferSchema": True, "sep": "\t", "escape": '"'}),
        Format("adt", ("adt",), "csv", {"header": True, "sep": UNIT, "lineSep": RECORD, "quote": ""}),
        Format("json", ("json",), "json", {"multiLine": True}),
        Format("jsonlines", ("jsonl", "ndjson"), "json"),
        Format("jsoncompact", ("jsonc",), "json", {"multiLine": True}),
        Format("json5", ("json5",), None, writes=False),
        Format("parquet", ("parquet",), "parquet"),
        Format("orc", ("orc",), "orc"),
        Format("avro", ("avro",), "avro"),
        Format("arrow", ("arrow", "feather", "ipc"), None),
        Format("excel", ("xlsx",), None),
    )
}
ALIASES = {"jsonl": "jsonlines", "ndjson": "jsonlines", "jsonc": "jsoncompact", "xlsx": "excel", "feather": "arrow", "ipc": "arrow"}
# First bytes of binary formats.
MAGIC = {b"PAR1": "parquet", b"Obj\x01": "avro", b"ARROW1": "arrow", b"ORC": "orc", b"PK\x03\x04": "excel"}


def by_name(name: str) -> Format:
    found = FORMATS.get(ALIASES.get(name.lower(), name.lower()))
    if found is None:
        raise ValueError(f"no format {name!r}")
    return found


def format_of(path: str) -> Format | None:
    """The format of a file by its ending; compression endings are looked through."""
    base = re.sub(r"\.(gz|bz2|zst|snappy|lz4|deflate)$", "", path.rstrip("/").lower())
    ending = base.rsplit(".", 1)[-1]
    return next((f for f in FORMATS.values() if ending in f.endings), None)


def format_of_bytes(head: bytes) -> Format | None:
    """The format by content: magic bytes, whole JSON, JSON lines, or steady numbers of separators."""
    for magic, name in MAGIC.items():
        if head.startswith(magic):
            return FORMATS[name]
    text = head.decode("utf-8", "replace")
    if UNIT in text or RECORD in text:
        return FORMATS["adt"]
    lines = [line for line in text.splitlines() if line.strip()][:5]
    if len(lines) > 1 and all(_is_json(line) for line in lines[:-1]) and lines[0].lstrip()[:1] == "{":
        return FORMATS["jsonlines"]
    if text.lstrip()[:1] in "[{" and text.strip():
        return FORMATS["json"]
    for name, sep in (("tsv", "\t"), ("csv", ",")):
        counts = {line.count(sep) for line in lines}
        if len(counts) == 1 and counts.pop() > 0:
            return FORMATS[name]
    return None


def is_lines(head: bytes) -> bool:
    """Whether a JSON text holds one object a line (its first line is one by itself)."""
    line = head.decode("utf-8", "replace").lstrip().split("\n", 1)[0]
    return line[:1] == "{" and _is_json(line)


def _is_json(line: str) -> bool:
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def separator_of(text: str, candidates: str = ",;\t|") -> str:
    """The separator that the first lines use steadily and most often."""
    lines = [line for line in text.splitlines() if line.strip()][:20]
    best = [(min(n), c) for c in candidates if lines and (n := [_outside_quotes(line, c) for line in lines]) and min(n) > 0 and len(set(n)) == 1]
    return max(best)[1] if best else ","


def _outside_quotes(line: str, sep: str) -> int:
    return re.sub(r'"(?:[^"]|"")*"', "", line).count(sep)


def json5_to_json(text: str) -> str:
    """Plain JSON of a JSON5 text: comments, single quotes, bare keys, trailing commas."""
    strings: list[str] = []

    def keep(m: re.Match) -> str:
        token = m[0]
        if token.startswith(("//", "/*")):
            return " "
        body = token[1:-1]
        if token[0] == "'":
            body = body.replace("\\'", "'").replace('"', '\\"')
        strings.append(f'"{body}"')
        return f"\0{len(strings) - 1}\0"

    bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|//[^\n]*|/\*.*?\*/", keep, text, flags=re.S)
    bare = re.sub(r"([{,]\s*)([A-Za-z_$][\w$]*)(\s*:)", r'\1"\2"\3', bare)
    bare = re.sub(r",(\s*[}\]])", r"\1", bare)
    bare = re.sub(r"(?<![\w.])\+(?=[\d.])", "", bare)
    bare = re.sub(r"(?<![\w\"])0[xX][0-9a-fA-F]+", lambda m: str(int(m[0], 16)), bare)
    bare = re.sub(r"(?<![\w.])\.(?=\d)", "0.", bare)
    return re.sub(r"\0(\d+)\0", lambda m: strings[int(m[1])], bare)
