"""Token-id arrays: encode, truncate, count, mask, pad, shift.

Encoders are column functions text -> ids: ``pieces.piece_encoder`` (subword
pieces of a given vocabulary), or ``word_length_ids``, a native Spark
expression whose ids SQL can give as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col
from .text import words

IGNORE_INDEX = -100


def word_length_ids(c) -> Column:
    """Whitespace words mapped to their length (a deterministic toy encoder)."""
    return F.transform(words(c), lambda w: F.length(w))


encode_words = word_length_ids


def subword_encode(c, encoder: Callable[[Column], Column], max_len: int | None = None) -> Column:
    """Encode text, truncated to ``max_len``; ``encoder`` is a column
    function text -> ids such as :func:`.pieces.piece_encoder` gives."""
    ids = encoder(as_col(c))
    return truncate(ids, max_len) if max_len else ids


def truncate(ids, n: int) -> Column:
    return F.slice(as_col(ids), 1, n)


def token_count(ids) -> Column:
    """Number of tokens."""
    return F.size(as_col(ids))


def mask_padding(labels, pad_id: int) -> Column:
    """Pad id -> -100 (ignored by the loss)."""
    return F.transform(as_col(labels), lambda x: F.when(x == pad_id, F.lit(IGNORE_INDEX)).otherwise(x))


def unmask_labels(labels, pad_id: int) -> Column:
    """-100 -> pad id before decoding references."""
    return F.transform(as_col(labels), lambda x: F.when(x == IGNORE_INDEX, F.lit(pad_id)).otherwise(x))


def padded_length(n, multiple_of: int | None = None) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    if multiple_of:
        return (F.ceil(n / multiple_of) * multiple_of).cast("int")
    return n.cast("int")


def pad_to(ids, n, pad_id: int, multiple_of: int | None = None) -> Column:
    """Right-pad ``ids`` with ``pad_id`` to length ``n`` (rounded up to
    ``multiple_of``).  ``n`` may be a Column, e.g. the longest row of the batch."""
    ids = as_col(ids)
    target = padded_length(n, multiple_of)
    missing = F.greatest(target - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad_id), missing))


def shift_for_next_token(pred, label) -> Column:
    """Pair prediction t with label t+1: arrays_zip(pred[:-1], label[1:])."""
    pred, label = as_col(pred), as_col(label)
    n = F.size(label) - 1
    return F.when(n > 0, F.arrays_zip(F.slice(pred, 1, n).alias("p"), F.slice(label, 2, n).alias("l"))) \
        .otherwise(F.array().cast("array<struct<p:int,l:int>>"))
