"""Arrays of numbers packed into bytes, for tables whose rows hold many."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, without the planes that are zero, entropy-coded: high planes take few bits."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    keep = 8
    while keep > 1 and not planes[keep - 1].any():
        keep -= 1
    return bytes([keep]) + zstandard.ZstdCompressor(level=1).compress(planes[:keep].tobytes())


def unpack(data: bytes) -> np.ndarray:
    keep = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(keep, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :keep] = planes.T
    return out.view("<u8").ravel()
