"""The public byte-level vocabulary: ids of whole texts, equal to those of the ``tokenizers`` file of the same name."""

from __future__ import annotations

import base64
import functools

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k"
END_OF_TEXT = "<|endoftext|>"
END_ID = 50256


@functools.cache
def encoding(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: END_ID})


@functools.cache
def byte_lengths(vocabulary: str = VOCABULARY) -> np.ndarray:
    """Number of bytes of every token."""
    enc = encoding(vocabulary)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(END_ID + 1)], np.int64)


def ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Token ids of a whole text; the special token's string in a text is that token, as in the JSON file."""
    enc = encoding(vocabulary)
    got = enc.encode(text, allowed_special="all") if END_OF_TEXT in text else enc.encode_ordinary(text)
    return np.asarray(got, "<u4")
