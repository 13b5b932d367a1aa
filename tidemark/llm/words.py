"""Words of letters, digits and all characters beyond ASCII, in lower case: texts as bytes, cut by one table and one split."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: A-Z to a-z, digits and bytes beyond ASCII to themselves, everything else to a space. Only A-Z are lower-cased.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text that are made words at once.
STRETCH = 1 << 20


def stretches(text: bytes | None, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of those of about `size` bytes, so that long texts don't take more memory."""
    if not text:
        return
    plain, at = text.translate(TABLE), 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= size else plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        if found := plain[at:end].split():
            yield found
        at = end


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
