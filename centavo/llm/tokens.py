"""Token ids from public vocabulary files; nothing is trained here."""

from __future__ import annotations

import base64
from collections.abc import Callable

import public_tokenizers
import tiktoken
import tiktoken.registry

#: The same vocabulary and merges as byte_bpe_50k.json, in the form that encodes fastest; the added token is the json's.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
ADDED = {BYTE_BPE: {"<|endoftext|>": 50256}}
MULTI_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encoding(path: str) -> tiktoken.Encoding:
    """One encoding a worker process and file; encode_ordinary takes the added tokens' strings as ordinary text, encode_added as these tokens."""
    known = tiktoken.registry.ENCODINGS
    if path not in known:
        known[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens=ADDED.get(path, {}))
    return known[path]


def encode_added(path: str) -> Callable[[str], list[int]]:
    """As tokenizers encodes by default: the added tokens' strings become these tokens."""
    known, names = encoding(path), list(ADDED.get(path, {}))
    return lambda text: known.encode(text, allowed_special="all") if any(x in text for x in names) else known.encode_ordinary(text)
