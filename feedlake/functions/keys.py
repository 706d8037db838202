"""Partition keys, file names and lock hashes."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Sequence

# FNV-1a's offsets and primes, by bits.
FNV = {64: (0xCBF29CE484222325, 0x100000001B3), 32: (0x811C9DC5, 0x01000193)}


def format_key(parts: Sequence[str], values: Sequence[str]) -> str:
    """``a=1/b=2`` of part names and values."""
    return "/".join(f"{p}={v}" for p, v in zip(parts, values, strict=True))


def parse_key(key: str, parts: Sequence[str]) -> list[str]:
    """Values of a partition key whose names must be ``parts`` in order; values may hold ``=``, not ``/``."""
    segments = key.split("/")
    if not key or len(segments) != len(parts):
        raise ValueError(f"partition key {key!r} needs {len(parts)} segments, one for each of {list(parts)}")
    values = []
    for segment, part in zip(segments, parts, strict=True):
        name, sign, value = segment.partition("=")
        if not sign or not name or name != part:
            raise ValueError(f"partition key {key!r}: {segment!r} should name {part!r}")
        if not value:
            raise ValueError(f"partition key {key!r}: {part!r} has no value")
        values.append(value)
    return values


def _fnv(text: str, bits: int) -> int:
    h, prime = FNV[bits]
    for b in text.encode():
        h = ((h ^ b) * prime) & ((1 << bits) - 1)
    return h


def fnv64a(text: str) -> int:
    """64-bit FNV-1a of a text's UTF-8 bytes: names a partition's lock."""
    return _fnv(text, 64)


def fnv32a(text: str) -> int:
    """32-bit FNV-1a of a text's UTF-8 bytes: names a store's sequencer lock."""
    return _fnv(text, 32)


_last, _guard = 0, threading.Lock()


def uuid7() -> str:
    """A version-7 UUID, later than every one this process made before."""
    global _last
    with _guard:
        # 48 bits of milliseconds, then 12 that count within one; a full count borrows from the next
        _last = max(_last + 1, (time.time_ns() // 1_000_000) << 12)
        stamp = _last
    rest = int.from_bytes(os.urandom(8), "big") & ((1 << 62) - 1)
    n = (stamp >> 12) << 80 | 7 << 76 | (stamp & 0xFFF) << 64 | 2 << 62 | rest
    x = f"{n:032x}"
    return "-".join((x[:8], x[8:12], x[12:16], x[16:20], x[20:]))
