"""Byte-pair ids of whole texts.

Ids are those of the ``tokenizers`` file. The rank file holds the same vocabulary for a
library that encodes several times faster, so it does the work. The ``tokenizers`` file
encodes a text that spells out the special token, which only that file knows, and a text
whose runs of white space are too long for the other library's pattern (about 500,000
characters); ids are the same either way.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"


class BytePairs:
    """Encoder of one Python worker."""

    def __init__(self, ranks_path: str, tokenizer_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.tokenizer_path = tokenizer_path
        self.reference: dict[bool, object] = {}

    def by_file(self, text: str, special_as_text: bool) -> np.ndarray:
        from tokenizers import Tokenizer

        if special_as_text not in self.reference:
            self.reference[special_as_text] = Tokenizer.from_file(self.tokenizer_path)
            self.reference[special_as_text].encode_special_tokens = special_as_text
        return np.array(self.reference[special_as_text].encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_text(self, text: str, special_as_text: bool = False) -> np.ndarray:
        """Ids of one text; the special token's string is its id unless taken as text."""
        if SPECIAL in text and not special_as_text:
            return self.by_file(text, False)
        try:
            return self.plain.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the pattern's stack is used up by a run of white space
            return self.by_file(text, special_as_text)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (no nulls), in order."""
        return [self.encode_text(text) for text in texts.to_pylist()]


_worker: dict[tuple[str, str], BytePairs] = {}


def byte_pairs(ranks_path: str, tokenizer_path: str) -> BytePairs:
    """One encoder per Python worker and vocabulary, kept between tasks."""
    key = (ranks_path, tokenizer_path)
    if key not in _worker:
        _worker[key] = BytePairs(*key)
    return _worker[key]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.path(TOKENIZER)
