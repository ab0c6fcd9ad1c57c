"""Token ids of whole texts by a public byte-level BPE file (the `tokenizers` JSON form).

The ids are those of `tokenizers` with add_special_tokens=False: a special token's string in a text becomes that token, as there.
The vocabulary of the file is run by `tiktoken`, which encodes ordinary texts about five times as fast. `tokenizers` itself encodes
the texts that hold a special token's string, and those whose runs of white space (about a million) are too long for the other's
pattern matcher; tests/llm hold both against each other.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: How such files cut a text before merging (fixed by the format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    """The vocabulary of the contract's queries, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The format's letter for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoding(path: str):
    """The fast encoder, and the strings of added tokens, which it does not know."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added, byte = [t["content"] for t in spec.get("added_tokens", [])], _bytes_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), added


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids(path: str, text: str | None) -> np.ndarray:
    """The ids of one whole text, unsigned 32-bit; null counts as empty."""
    if not text:
        return np.zeros(0, np.uint32)
    fast, added = encoding(path)
    if not any(x in text for x in added):
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except ValueError as e:  # the pattern matcher's stack, at very long runs of white space
            if "backtracking" not in str(e):
                raise
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
