"""Words of whole Arrow columns at once: bytes are mapped and cut at white space without a Python string a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Byte for byte: A-Z to a-z. Bytes of longer characters never change.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The same, and every ASCII character but letters and digits to a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(texts: pa.Array, table: bytes) -> tuple[np.ndarray, pa.Array]:
    """(words a text, all words in order) of a string column without nulls, after the byte map ``table``."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    data = pa.py_buffer(bytes(data).translate(table)) if data is not None else pa.py_buffer(b"")
    mapped = pa.LargeStringArray.from_buffers(len(texts), places, data, None, 0, texts.offset)
    cut = pc.ascii_split_whitespace(mapped)
    flat, ends = cut.flatten(), np.asarray(cut.offsets, dtype=np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return np.diff(before[ends - ends[0]]), flat.filter(full)
