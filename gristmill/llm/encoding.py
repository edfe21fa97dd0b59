"""Token ids of whole texts, exactly as the tokenizers library gives them for a tokenizer file."""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import tiktoken
import tokenizers

DEFAULT = "byte_bpe_50k.json"

# Texts of these characters are split alike by every Unicode version and by both libraries.
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧€]")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves,
    the others follow from code point 256 in byte order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes plain Latin texts with tiktoken over the same vocabulary and all others with the
    library itself; the ids are the library's in either case (tested against it)."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", []) if x.get("special")}
        self.fast = None
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if spec["model"]["type"] == "BPE" and plain and not spec.get("normalizer"):
            byte = _byte_of_char()
            ranks = {
                bytes(byte[c] for c in piece): rank
                for piece, rank in spec["model"]["vocab"].items()
                if piece not in special
            }
            self.fast = tiktoken.Encoding(
                "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
            )

    @cached_property
    def library(self) -> tokenizers.Tokenizer:
        """Loaded when the first text needs it."""
        return tokenizers.Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or _ODD.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")

    def count(self, text: str) -> int:
        return len(self.ids(text))


@lru_cache(maxsize=4)
def encoder(name: str = DEFAULT) -> Encoder:
    """One encoder per worker process."""
    return Encoder(public_tokenizers.path(name))


def version_digest(name: str = DEFAULT) -> str:
    """Identifies tokenizer file and library release."""
    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()
