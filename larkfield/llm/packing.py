"""Lists of whole numbers as compressed bytes, for rows that carry a list through a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC, _DENSE = pa.Codec("lz4_raw"), pa.Codec("zstd", compression_level=1)
_IS_DENSE = 128


def packed(values: np.ndarray, dense: bool = False) -> bytes:
    """Numbers from 0 on in as few bytes each as they need, byte plane by byte plane, compressed.

    ``dense`` takes about half the bytes for counts, of which most are small, and more time.
    """
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()
    codec = _DENSE if dense else _CODEC
    return bytes([width | dense * _IS_DENSE]) + len(planes).to_bytes(8, "little") + codec.compress(planes, asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    width, codec = blob[0] % _IS_DENSE, _DENSE if blob[0] & _IS_DENSE else _CODEC
    size = int.from_bytes(blob[1:9], "little")
    if not size:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(codec.decompress(blob[9:], size, asbytes=True), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)
