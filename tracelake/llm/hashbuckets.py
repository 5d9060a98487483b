"""Hash exchange in packed rows.

A per-word shuffle moves a row for every hash. Here a task gathers its hashes by bucket and emits
one row with a packed array for each bucket and flush; the reducing side unpacks a bucket into
numpy. The number of buckets grows with the input, so what one bucket holds does not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textkernel import U64

#: Hashes a bucket should hold, and hashes a task gathers before it emits.
PER_BUCKET, FLUSH = 500_000, 500_000
BUCKET_SCHEMA = "bucket int, blob binary"


def bucket_count(hashes: float) -> int:
    """A multiple of 256, so that the low 8 bits of a hash follow from its bucket."""
    return 256 * max(1, -(-int(hashes) // (256 * PER_BUCKET)))


def pack(*columns: np.ndarray) -> bytes:
    """Integer arrays, each in the least width that holds it, or rows of bytes as they are."""
    out = []
    for x in columns:
        if x.ndim == 1:
            least, most = (int(x.min()), int(x.max())) if len(x) else (0, 0)
            x = x.astype(next((f"<u{w}" for w in (1, 2, 4, 8) if most < 1 << 8 * w), "<u8") if least >= 0 else "<i8")
        code = f"{x.dtype.kind}{x.dtype.itemsize}" if x.ndim == 1 else f"b{x.shape[1]}"
        raw = np.ascontiguousarray(x).tobytes()
        out += [code.encode().ljust(4), len(raw).to_bytes(8, "little"), raw]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of a blob; integers come back as int64, or uint64 where they need it."""
    out, at = [], 0
    while at < len(data):
        code, size = data[at : at + 4].decode().strip(), int.from_bytes(data[at + 4 : at + 12], "little")
        raw = data[at + 12 : at + 12 + size]
        if code[0] == "b":
            x = np.frombuffer(raw, dtype=np.uint8).reshape(-1, int(code[1:]))
        else:
            x = np.frombuffer(raw, dtype=f"<{code}")
            x = x if code == "u8" else x.astype(np.int64)
        out.append(x)
        at += 12 + size
    return out


def steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column of numbers as its first and the zigzag of its differences; small where x is nearly sorted."""
    d = np.diff(x.astype(np.int64))
    return x[:1].astype(np.int64), ((d << 1) ^ (d >> 63)).view(np.uint64)


def unsteps(first: np.ndarray, d: np.ndarray) -> np.ndarray:
    d = d.astype(np.uint64)
    back = (d >> U64(1)).astype(np.int64) ^ -(d & U64(1)).astype(np.int64)
    return np.cumsum(np.concatenate([first.astype(np.int64), back]))


def seven(h: np.ndarray) -> np.ndarray:
    """The upper 7 bytes of each hash, as rows of bytes."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:])


def eight(rows: np.ndarray) -> np.ndarray:
    """Hashes of 7-byte rows, with the low byte 0."""
    full = np.zeros((len(rows), 8), dtype=np.uint8)
    full[:, 1:] = rows
    return full.reshape(-1).view("<u8")


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h % U64(n)).astype(np.int64)


def rows(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])
