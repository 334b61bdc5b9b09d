"""Encoding of a whole corpus by a public tokenizer.

Every text longer than a small piece is halved until its pieces are small. The
pieces are encoded by themselves, those of very long texts in different tasks,
and their ids are joined pairwise as a tree. At each join a window of ids on
both sides of the cut is encoded anew and grows until both sides agree: each
edge of the window is a border of the tokenizer's pattern, or lies within one
of its parts with ids on either side that are an encoding of their bytes. Both
prove the joined ids to be those of the whole (see `vocab`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.llm.vocab import DEFAULT_FOLDER, encoder, fits, is_border, is_within, token_ids
from tidecue.session import spread

#: Characters of a piece at most; the same tree is joined whatever task encodes its pieces.
PIECE_CHARS = 2_048
#: Characters from which on a text's pieces are spread over tasks instead of staying in one.
SPREAD_CHARS = 65_536
#: Tokens of the first window on either side of a cut.
WINDOW = 6
#: Characters beside a cut within which a contraction may depend on the other side.
CONTRACTION = 3


def halve(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text's halves, quarters and so on, until no piece is longer than size; one piece if it is short."""
    n = 1
    while len(text) > n * max(1, size):
        n *= 2
    edges = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(edges, edges[1:])]


def _starts_character(raw: bytes, at: int) -> bool:
    return raw[at] & 0xC0 != 0x80


def _edge(ids: np.ndarray, most: int, leading: bool, enc) -> tuple[int, bytes, bool] | None:
    """The edge of a window of at most `most` tokens on one side of a cut: (tokens, bytes between it and the cut, whether it is a border).

    leading is True for the side before the cut. The nearest border wins; else
    the farthest place within a part, and at last the end of the side. None if
    the window must grow.
    """
    near = ids[len(ids) - most :] if leading else ids[:most]
    pieces = enc.decode_tokens_bytes(near.tolist())
    raw = b"".join(pieces)
    offsets = np.cumsum([0, *map(len, pieces)])
    within = None
    for tokens in range(1, len(pieces)):
        at = int(offsets[len(pieces) - tokens] if leading else offsets[tokens])
        if not _starts_character(raw, at):
            continue
        inner = raw[at:] if leading else raw[:at]
        if len(inner.decode("utf-8", "replace")) < CONTRACTION:
            continue
        before, after = raw[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:], raw[at : at + 4].decode("utf-8", "ignore")[:1]
        if not before or not after:
            continue
        if is_border(before, after):
            return tokens, inner, True
        # no apostrophe may stand near enough to make a contraction of letters
        seen = at >= CONTRACTION or not leading or most == len(ids)
        if seen and is_within(before, after) and b"'" not in raw[max(0, at - CONTRACTION) : at + 1]:
            within = tokens, inner, False
    return within or ((len(ids), raw, True) if most == len(ids) else None)


def join_ids(left: np.ndarray, right: np.ndarray, enc) -> np.ndarray:
    """Ids of the text whose two parts have these ids."""
    if not len(left) or not len(right):
        return np.concatenate((left, right))
    most = WINDOW
    while True:
        a = _edge(left, min(most, len(left)), True, enc)
        b = _edge(right, min(most, len(right)), False, enc)
        if a and b:
            window = enc.encode_ordinary((a[1] + b[1]).decode("utf-8"))
            agrees = (a[2] or fits(enc, int(left[len(left) - a[0] - 1]), window[0])) and (b[2] or fits(enc, window[-1], int(right[b[0]])))
            if agrees:
                return np.concatenate((left[: len(left) - a[0]], np.array(window, dtype=left.dtype), right[b[0] :]))
        if most >= len(left) and most >= len(right):  # both sides lie wholly within the window
            whole = b"".join(enc.decode_tokens_bytes([*left.tolist(), *right.tolist()])).decode("utf-8")
            return token_ids(enc, whole)
        most *= 2


def join_tree(parts: list[np.ndarray], enc) -> np.ndarray:
    """Ids of a whole text from its pieces' ids, joined pairwise level by level."""
    while len(parts) > 1:
        parts = [join_ids(parts[i], parts[i + 1], enc) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def encode_text(text: str, enc, size: int = PIECE_CHARS) -> np.ndarray:
    """Ids of a text, those of a long one by the tree of its halves."""
    return join_tree([token_ids(enc, piece) for piece in halve(text, size)], enc)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, ids)])
    values = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32)))


def encode_documents(df: DataFrame, tokenizer: str = "byte_bpe_50k", id_column: str = "doc_id", text_column: str = "text", folder: str = DEFAULT_FOLDER, piece_chars: int = PIECE_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """Columns (id, ids): token ids of each row's text, without special tokens.

    One output row per input row, repeated rows included. Empty and null texts
    give an empty list; a null id stays null. Special-token strings in a text
    are ordinary text. Other columns are ignored. An empty table gives none.
    """
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([encode_text(t, enc, piece_chars) for t in batch.column(1).to_pylist()])], names=["id", "ids"])

    near = spread(rows.where(F.length("text") <= spread_chars)).mapInArrow(whole, f"id {kind}, ids array<int>")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, i, text in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                parts = halve(text, piece_chars)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([u.as_py()] * n, pa.int64()), pa.array([i.as_py()] * n, batch.schema.field(1).type), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], names=["u", "id", "no", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists([token_ids(enc, t) for t in batch.column(3).to_pylist()])], names=["u", "id", "no", "ids"])

    def together(group: pa.Table) -> pa.Table:
        enc = encoder(tokenizer, folder)
        parts = sorted(zip(group["no"].to_pylist(), group["ids"].to_pylist()))
        return pa.table({"id": group["id"][:1], "ids": _lists([join_tree([np.array(ids, dtype=np.uint32) for _, ids in parts], enc)])})

    far = (
        rows.where(F.length("text") > spread_chars)
        .select(F.monotonically_increasing_id().alias("u"), "id", "text")
        .mapInArrow(pieces, f"u long, id {kind}, no int, text string")
        .repartition("u", "no")
        .mapInArrow(encode, f"u long, id {kind}, no int, ids array<int>")
        .groupBy("u")
        .applyInArrow(together, f"id {kind}, ids array<int>")
    )
    return near.unionByName(far).withColumnRenamed("id", id_column)
