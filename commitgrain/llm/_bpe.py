"""Byte-pair vocabularies as read from a tokenizer's JSON file."""

from __future__ import annotations

import json
import os
from functools import lru_cache


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    spare = 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


@lru_cache(maxsize=4)
def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def merge_ranks(model: dict) -> dict[tuple[str, str], int]:
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
    return {pair: rank for rank, pair in enumerate(pairs)}


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply merges, lowest rank first and leftmost among equals."""
    none = len(ranks)
    while len(symbols) > 1:
        found = [ranks.get(p, none) for p in zip(symbols, symbols[1:])]
        best = min(found)
        if best == none:
            break
        out, i = [], 0
        while i < len(symbols):
            if i < len(found) and found[i] == best:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def mark(path: str) -> str:
    """What all special strings begin with: a text without it has none."""
    return os.path.commonprefix(list(special_strings(path)))


def special_strings(path: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in load(path)["added_tokens"]}


class Memo(dict):
    """A dictionary of bounded size in two generations: when the younger one has
    half of the limit it becomes the older one, and what is used again from the
    older one moves to the younger."""

    def __init__(self, make, limit: int = 300_000):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit // 2:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
