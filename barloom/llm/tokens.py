"""Token ids of documents, with a public byte-level vocabulary.

The ids are those of ``tokenizers`` with ``byte_bpe_50k.json`` and no special tokens added; they are
computed with ``tiktoken`` on the same vocabulary, which is several times faster (the tests compare the
two). A document's ids end with ``END``. Vocabulary files are named, not shipped: each worker opens its own.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np

from barloom.llm.ship import by_value

by_value(__name__)

VOCABULARY = "byte_bpe_50k"
END = 0
SPECIAL = {"<|endoftext|>": 50256}


class Encoder:
    """Text to ids, from the vocabulary's merge ranks."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )

    def __call__(self, text: str | None) -> np.ndarray:
        """A document: its ids, then END."""
        ids = self.encoding.encode_to_numpy(text or "", allowed_special="all")
        return np.append(ids, np.uint32(END)).astype("<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, then the rest."""
    return [(at, min(capacity, n - at)) for at in range(0, n, capacity)]


def cut_short_first(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids, of which only the first may be shorter than ``capacity``."""
    head = n % capacity or min(capacity, n)
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))] if n else []


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
