"""Token ids of whole texts by a byte-level BPE vocabulary (a file of the tokenizers library).

The file defines the ids, as the tokenizers library gives them. That library takes about 0.3 CPU seconds a MB of text, so
texts of characters that every Unicode version classes alike, without the vocabulary's special strings, go through
tiktoken's BPE core over the same file's vocabulary and the file's splitting pattern, which gives the same ids
in a quarter of the time; all other texts go through the tokenizers library itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from tideline.llm.bpe import byte_symbols

#: The published splitting pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = {x["content"] for x in spec["added_tokens"]}
        self.marks = sorted(special)
        of = byte_symbols()
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        # Latin, Greek, Cyrillic, and common punctuation and signs
        self.steady = re.compile("[\0-ɏΑ-ΡΣ-ωЀ-џ‐-‧‰-›€™]*")

    def plain(self, text: str) -> bool:
        if any(m in text for m in self.marks):
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return self.steady.fullmatch(text) is not None

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; null counts as empty."""
        if not text:
            return np.empty(0, self.dtype)
        if self.plain(text):
            return self.core.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One per worker process."""
    return TextEncoder(path)
