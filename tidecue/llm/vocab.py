"""Byte-level BPE vocabularies of the public tokenizer folder, and where their encodings may be cut.

The tokenizers first part a text by PATTERN and then merge bytes within each
part. PATTERN never looks back, and no part holds two kinds of characters but
for a leading space and the contractions. Two facts follow, on which joining
and cutting rely:

* Between two characters of unlike kinds, the first no white space and no
  apostrophe before a letter, there is a border of parts in any context, and
  neither side's ids depend on the other (`is_border`).
* Within a part, ids are the encoding of their bytes if and only if each two
  neighbouring ids are the encoding of theirs: the first merge over a place
  between two tokens would also happen if those two stood alone, as all merges
  within them come in the same order. So any stretch of an encoding is one
  itself, and two stretches may be joined where the ids beside the seam are an
  encoding (`fits`).
"""

from __future__ import annotations

import base64
import os
import unicodedata
from functools import lru_cache

import numpy as np

#: Folder of the vocabulary files; every operator takes another as a parameter.
DEFAULT_FOLDER = "/opt/tokenizers"

#: Fixed value: the published pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(name: str, folder: str = DEFAULT_FOLDER):
    """The tokenizer of NAME.tiktoken; special tokens are ordinary text to it."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def byte_lengths(enc) -> np.ndarray:
    """Number of bytes of each token id."""
    out = np.zeros(enc.n_vocab, dtype=np.int64)
    for token in enc.token_byte_values():
        out[enc.encode_single_token(token)] = len(token)
    return out


def token_ids(enc, text: str) -> np.ndarray:
    """Ids of a text as an array."""
    return np.array(enc.encode_ordinary(text), dtype=np.uint32)


class _Kinds(dict):
    """Character to its kind in PATTERN: L, N, S (white space) or O; empty where versions of Unicode may differ."""

    def __missing__(self, ch: str) -> str:
        category = unicodedata.category(ch)
        if ch in "\t\n\x0b\x0c\r \x85" or category in ("Zs", "Zl", "Zp"):
            kind = "S"
        elif category == "Cn" or "\x1c" <= ch <= "\x1f":
            kind = ""
        else:
            kind = category[0] if category[0] in "LN" else "O"
        self[ch] = kind
        return kind


KIND = _Kinds()


def is_border(before: str, after: str) -> bool:
    """Whether parts of PATTERN meet between these two characters whatever stands around them."""
    a, b = KIND[before], KIND[after]
    return bool(a and b) and a != b and a != "S" and not (before == "'" and b == "L")


def is_within(before: str, after: str) -> bool:
    """Whether a text that begins between these characters goes on as it would have within its part."""
    a = KIND[before]
    return a in ("L", "N", "O") and a == KIND[after] and after != "'" and before != "'"


def fits(enc, before: int, after: int) -> bool:
    """Whether two neighbouring ids are the encoding of their bytes."""
    pair = enc.decode_single_token_bytes(before) + enc.decode_single_token_bytes(after)
    return enc._encode_single_piece(pair) == [before, after]


def keeps_ids(text: str, start: int, end: int) -> bool:
    """Whether the ids of text[start:end] are those that stand between these places in the text's encoding.

    Both places must be ends of tokens. False means that it can't be told.
    """
    if start and "'" in text[max(0, start - 3) : start + 1]:
        return is_border(text[start - 1], text[start])
    if start and not (KIND[text[start - 1]] and KIND[text[start]]):
        return False
    if end < len(text):
        last, after = text[end - 1], text[end]
        if "'" in text[max(0, end - 3) : end + 1]:
            return is_border(last, after)
        if not (KIND[last] and KIND[after]):
            return False
        # white space at the end would be parted otherwise without what follows
        if KIND[last] == "S" and KIND[after] != "S" and end > 1 and KIND[text[end - 2]] in ("S", ""):
            return False
    return True
