"""Token ids of a public byte-level BPE.

Texts go whole to the encoder, which takes less time than looking up every word and keeps
nothing. The encoder's pattern recurses on very long runs of white space; a text with such
a run is cut into words by an equivalent pattern of the standard library, if it has common
Latin characters only. A word's ids never depend on its neighbours.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array

import public_tokenizers
import tiktoken

from .words import worker_cache

# Characters for which the standard library's classes agree with the tokenizer's.
_COMMON = re.compile("[\t\n\r\x20-\x7eÀ-ɏ]*")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
LONG_RUN = 10_000
_SPACES = re.compile(r"\s{%d}" % LONG_RUN)


def _bytes(ids: list[int]) -> bytes:
    """Little-endian 16-bit numbers."""
    return array("H", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(2, "little") for i in ids)


def encoder(path: str | None = None):
    """Function from text to ids (bytes, 16 bits each); its tables are kept by the worker."""
    cache = worker_cache()
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if ("bpe", path) not in cache:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache["bpe", path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoding = cache["bpe", path]

    ids_of_word = encoding._core_bpe.encode_single_piece

    def encode(text: str) -> bytes:
        if len(text) >= LONG_RUN and _SPACES.search(text) and _COMMON.fullmatch(text):
            return b"".join(_bytes(ids_of_word(word.encode())) for word in _WORD.findall(text))
        return _bytes(encoding.encode_ordinary(text))

    return encode
