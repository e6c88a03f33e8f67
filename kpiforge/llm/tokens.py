"""Byte-level BPE engines built from public vocabulary files, one per Python worker."""

from __future__ import annotations

import base64
import json

from kpiforge.llm.common import worker_cache


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary.

    Printable bytes stand for themselves; the others, in order, are the code
    points from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file, or of a ``tokenizers`` JSON of byte-level BPE.

    In such JSON files the ids of merged tokens follow the order of the
    merges, so an id is a rank; special tokens are left out.
    """
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"] if t["special"]}
    of = _byte_alphabet()
    return {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


def engine(path: str, pattern: str):
    """A tiktoken encoding without special tokens; built once per worker process."""
    import tiktoken

    cache = worker_cache()
    if (path, pattern) not in cache:
        cache[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return cache[path, pattern]
