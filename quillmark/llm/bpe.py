"""Byte-level BPE of the public tokenizers: ids as the `tokenizers` library gives them, by a faster route where equal."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: Texts of these characters alone are cut alike by both libraries; any other text goes to `tokenizers`.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ–—‘-„•…€]|<\\|endoftext\\|>")


class Bpe:
    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={})._core_bpe

    def ids(self, text: str) -> np.ndarray:
        """Token ids (uint32) of one text, without special tokens around it."""
        if self.fast is None or _PLAIN.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(self.fast.encode_to_tiktoken_buffer(text, set()), np.uint32)


@lru_cache(maxsize=4)
def load(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Bpe:
    """One encoder for each Python worker."""
    return Bpe(vocabulary, ranks, pattern)


def public(name: str = "byte_bpe_50k") -> tuple[str, str, str]:
    """Arguments of load() for a vocabulary of the installed public tokenizers."""
    import public_tokenizers as p

    return p.path(f"{name}.json"), p.path(f"{name}.tiktoken"), p.PATTERN
