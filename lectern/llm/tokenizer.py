"""Byte-level BPE by a public vocabulary file. The path is always a parameter; vocabularies are never copied or trained."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def bpe(path: str):
    """An encoder of the ranks at ``path`` (one base64 token and its id a line). Its ids are those of the same vocabulary's
    JSON form in the tokenizers library; special tokens' strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _slow(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


#: A run of this many white-space characters or more goes through the slower library: the fast one's pattern backtracks on it.
LONG_BLANK = 2000


def encode(ranks: str, slow: str, text: str) -> np.ndarray:
    """uint32 ids of ``text``."""
    if len(text) >= LONG_BLANK and (" " * LONG_BLANK in text or any(c * LONG_BLANK in text for c in "\n\t\r")):
        return np.array(_slow(slow).encode(text, add_special_tokens=False).ids, np.uint32)
    return bpe(ranks).encode_to_numpy(text, disallowed_special=())


@cache
def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether its bytes end a sentence or a line."""
    e = bpe(path)
    return np.array([e.decode_single_token_bytes(i).endswith((b".", b"!", b"?", b"\n")) for i in range(e.n_vocab - (e.n_vocab == 50257))], bool)
