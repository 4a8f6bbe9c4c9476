"""Byte-level BPE ids of whole texts.

The vocabulary and merge order come from a ``tokenizers`` JSON file (its path
is a parameter; nothing is copied or trained).  Texts are encoded by
``tiktoken`` over the same vocabulary, which gives the same ids several times
faster; very long texts go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

# Longest text given to tiktoken, whose splitter has a backtracking limit.
LONG_TEXT = 1_000_000


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        byte = _byte_alphabet()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens=special)
        self._slow = None

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return np.asarray(self._fast.encode(text, allowed_special="all"), np.uint32)
        if self._slow is None:
            from tokenizers import Tokenizer
            self._slow = Tokenizer.from_file(self.path)
        return np.asarray(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)
