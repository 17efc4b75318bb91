"""The byte-level BPE encoder of a worker process, loaded once per vocabulary file.

It reads the vocabulary as ranks; its ids are those of the same vocabulary in the ``tokenizers`` form.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers

RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's one special token, with the id that its ranks leave free.
SPECIAL = {"<|endoftext|>": 50256}


class ByteBpe:
    """Ids of whole texts and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.token_bytes = {rank: token for token, rank in ranks.items()}

    def plain(self, text: str) -> np.ndarray:
        """Ids of ``text``; strings of special tokens are text like any other."""
        return self._encoding.encode_to_numpy(text, disallowed_special=())

    def special(self, text: str) -> np.ndarray:
        """Ids of ``text``, with special tokens where it holds their strings."""
        return self._encoding.encode_to_numpy(text, allowed_special="all")


@cache
def byte_bpe(path: str | None = None) -> ByteBpe:
    return ByteBpe(path or public_tokenizers.path(RANKS))
