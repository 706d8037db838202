"""What a store is: its record schema, partition parts, entity and version, metadata columns and views."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import types as T

from .errors import InvalidConfig
from .functions.values import KINDS

_NAME = re.compile(r"[a-z][a-z0-9_]*")
CODECS = ("snappy", "zstd", "gzip", "uncompressed")


@dataclass(frozen=True)
class ExtensionColumn:
    """A typed, nullable column of per-file metadata."""

    name: str
    kind: str


@dataclass(frozen=True)
class MaterializedView:
    """A set of text tuples: ``of`` is an array of structs of strings, from the columns of a record; ``into`` makes a caller's value of a tuple."""

    name: str
    columns: tuple[str, ...]
    of: Column
    into: Callable[..., object] | None = None


@dataclass(frozen=True)
class ReadOptions:
    """How far a reader may run ahead. Spark's own scheduling decides on decoding and fetching, so those numbers are hints that are only checked; files and bytes bound what one step of a stream or iterator reads."""

    decode_workers: int = 0
    fetch_ahead_files: int = 0
    decode_ahead_partitions: int = 0
    decode_ahead_files: int = 0
    decode_ahead_bytes: int = 0

    def __post_init__(self) -> None:
        if wrong := [n for n, v in vars(self).items() if v < 0]:
            raise InvalidConfig(f"negative: {wrong}")


@dataclass(frozen=True)
class StoreConfig:
    """A store's fixed description. ``parts`` are (name, column) pairs; entity and version come together or not at all."""

    root: str
    schema: T.StructType
    parts: Sequence[tuple[str, Column]]
    entity: Column | None = None
    version: Column | None = None
    extensions: Sequence[ExtensionColumn] = ()
    views: Sequence[MaterializedView] = ()
    codec: str = "snappy"
    missing_as_zero: bool = False
    clock: Callable[[], datetime] = field(default=lambda: datetime.now(UTC))

    @property
    def part_names(self) -> list[str]:
        return [n for n, _ in self.parts]

    def validate(self) -> None:
        """Raise one InvalidConfig that names every fault."""
        wrong: list[str] = []

        def names(what: str, found: Sequence[str]) -> None:
            for n in found:
                if not _NAME.fullmatch(n) or len(n) > 30:
                    wrong.append(f"{what} {n!r} must match {_NAME.pattern} and have 30 characters at most")
            if len({n.lower() for n in found}) < len(found):
                wrong.append(f"{what}s repeat: {list(found)}")

        if not self.root:
            wrong.append("root is empty")
        if not self.parts:
            wrong.append("at least one partition part is needed")
        names("part", self.part_names)
        names("extension", [e.name for e in self.extensions])
        names("view", [v.name for v in self.views])
        for e in self.extensions:
            if e.kind.upper() not in KINDS:
                wrong.append(f"extension {e.name!r} has unknown type {e.kind!r}")
        for v in self.views:
            names(f"view {v.name!r} column", v.columns)
            if not v.columns:
                wrong.append(f"view {v.name!r} has no columns")
        if (self.entity is None) != (self.version is None):
            wrong.append("entity and version must both be given or neither")
        if self.codec not in CODECS:
            wrong.append(f"codec {self.codec!r} is none of {CODECS}")
        if wrong:
            raise InvalidConfig("; ".join(wrong))
