"""Typed per-file metadata: checks, and text that round-trips."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import types as T

# The metadata types and what Spark keeps them as.
KINDS = {
    "TEXT": T.StringType(),
    "UUID": T.StringType(),
    "TIMESTAMPTZ": T.TimestampType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "NUMERIC": T.DecimalType(38, 18),
}
_BITS = {"INT": 31, "BIGINT": 63}
SIDECAR_BYTES = 2048


def check(kind: str, value: object) -> object:
    """``value`` as its kind is kept, or ValueError; null is always fine."""
    kind = kind.upper()
    if value is None:
        return None
    if kind == "TEXT" and isinstance(value, str):
        return value
    if kind == "UUID":
        if isinstance(value, uuid.UUID):
            return str(value)
        if isinstance(value, str) and len(value) == 36:
            return str(uuid.UUID(value))
    if kind == "TIMESTAMPTZ" and isinstance(value, datetime):
        return value.astimezone(UTC) if value.tzinfo else value.replace(tzinfo=UTC)
    if kind in _BITS and isinstance(value, int) and not isinstance(value, bool):
        if not -(1 << _BITS[kind]) <= value < 1 << _BITS[kind]:
            raise ValueError(f"{value} is out of {kind}'s range")
        return value
    if kind == "BOOLEAN" and isinstance(value, bool):
        return value
    if kind == "NUMERIC" and isinstance(value, (str, int, float, Decimal)) and not isinstance(value, bool):
        try:
            number = Decimal(str(value))
        except InvalidOperation:
            raise ValueError(f"{value!r} is no NUMERIC") from None
        if not number.is_finite() or number.adjusted() > 19 or number != number.quantize(Decimal(1).scaleb(-18)):
            raise ValueError(f"{value!r} does not fit decimal(38,18)")
        return number
    raise ValueError(f"{value!r} is no {kind}")


def to_text(kind: str, value: object) -> str | None:
    """A checked value as text."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, datetime):
        return value.astimezone(UTC).isoformat().replace("+00:00", "Z")
    if isinstance(value, Decimal):
        return format(value.normalize(), "f")
    return str(value)


def from_text(kind: str, text: str | None) -> object:
    """The value that ``to_text`` wrote."""
    kind = kind.upper()
    if text is None:
        return None
    if kind == "TIMESTAMPTZ":
        return check(kind, datetime.fromisoformat(text.replace("Z", "+00:00")))
    if kind in _BITS:
        return check(kind, int(text))
    if kind == "BOOLEAN":
        if text not in ("true", "false"):
            raise ValueError(f"{text!r} is no BOOLEAN")
        return text == "true"
    return check(kind, text)
