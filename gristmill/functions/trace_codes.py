"""Scheduler states, futex operations, integer forms and keyed pseudonyms of trace fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: task states by letter and by bit value, futex operations under the command mask
STATE_LETTERS = {
    "R": "running", "S": "interruptible_sleep", "D": "uninterruptible_sleep", "T": "stopped",
    "t": "traced", "X": "dead", "x": "dead", "Z": "dead", "P": "parked", "I": "idle",
}
STATE_BITS = {
    0: "running", 1: "interruptible_sleep", 2: "uninterruptible_sleep", 4: "stopped", 8: "traced",
    16: "dead", 32: "dead", 64: "parked", 1024: "idle",
}
FUTEX_MASK = 0x7F
FUTEX_WAITS = {0: "wait", 9: "wait_bitset", 11: "wait_requeue_pi"}
FUTEX_WAKES = {1: "wake", 3: "requeue", 10: "wake_bitset"}


def _lookup(value: Column, table: dict) -> Column:
    pairs = [x for key, name in table.items() for x in (F.lit(key), F.lit(name))]
    return F.try_element_at(F.create_map(*pairs), value)


def state_from_letter(raw: Column) -> Column:
    return F.coalesce(_lookup(F.regexp_replace(raw, r"\++$", ""), STATE_LETTERS), F.lit("unknown"))


def state_from_bits(value: Column) -> Column:
    return F.coalesce(_lookup(value.cast("int"), STATE_BITS), F.lit("unknown"))


def parse_integer(text: Column) -> Column:
    """Decimal or ``0x`` hexadecimal; 64-bit hexadecimal wraps to negative, ``-0x`` negates."""
    digits = F.regexp_replace(text, r"^-?0x", "")
    wrapped = F.conv(digits, 16, -10).try_cast("bigint")
    return (
        F.when(text.rlike(r"^-0x[0-9a-fA-F]+$"), -wrapped)
        .when(text.rlike(r"^0x[0-9a-fA-F]+$"), wrapped)
        .when(text.rlike(r"^-?[0-9]+$"), text.try_cast("bigint"))
    )


def futex_operation(op: Column) -> Column:
    return _lookup(op.bitwiseAND(F.lit(FUTEX_MASK).cast("bigint")).cast("int"), {**FUTEX_WAITS, **FUTEX_WAKES})


def futex_kind(op: Column) -> Column:
    """``futex_wait`` or ``futex_wake``, null for other operations."""
    command = op.bitwiseAND(F.lit(FUTEX_MASK).cast("bigint")).cast("int")
    return F.when(command.isin(*FUTEX_WAITS), "futex_wait").when(command.isin(*FUTEX_WAKES), "futex_wake")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA-256 of a string column under a driver-held key."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in block))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in block))
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def lock_pseudonym(key: bytes, address: Column) -> Column:
    """Stable id of a raw lock address that cannot be turned back without the key."""
    lowered = F.lower(address)
    normalized = F.when(F.startswith(lowered, F.lit("0x")), lowered).otherwise(F.concat(F.lit("0x"), lowered))
    return F.concat(F.lit("lock-"), F.substring(hmac_sha256(key, normalized), 1, 20))


def event_id(*parts: Column) -> Column:
    """Hashed event id over ``:``-joined parts."""
    joined = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.concat(F.lit("event-"), F.substring(F.sha2(F.encode(joined, "UTF-8"), 256), 1, 24))
