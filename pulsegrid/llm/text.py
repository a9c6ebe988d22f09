"""Text helpers shared by the operators: folded words as bytes, and Arrow plumbing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

# A-Z become a-z; digits, letters and all bytes of non-ASCII characters stay; the rest separates words.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
# A-Z become a-z, all else stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def folded_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased UTF-8 text, in order."""
    return text.translate(FOLD).split()


def raw_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def narrow(docs, **columns):
    """Only the named inputs under fixed names, so that other columns of any name are left behind."""
    return docs.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
