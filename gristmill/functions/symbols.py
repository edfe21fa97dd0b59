"""Symbol, event and percent expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names and patterns that identify symbols, events and kernel objects
UNKNOWN = "unknown"
UNKNOWN_SYMBOLS = ("[unknown]", "unknown", "0x0", "??")
ADDRESS_OFFSET = r"\+0x[0-9a-fA-F]+$"
COMPILER_SUFFIX = r"\.(?:isra|constprop|part)\.\d+$"
RUST_HASH = r"::h[0-9a-f]{16,17}$"
EVENT_MODIFIER = r"^(.*):[ukhGHpPSDWebR]+$"
PMU_EVENT = (
    r"^(?:cpu|cpu_core|cpu_atom)/"
    r"(cycles|instructions|cache-references|cache-misses|branches|branch-misses)/$"
)
CLOCK_EVENTS = ("cpu-clock", "task-clock")
ON_CPU_EVENTS = ("cpu-clock", "task-clock", "cycles")


def strip_address_offset(raw: Column) -> Column:
    return F.regexp_replace(F.trim(raw), ADDRESS_OFFSET, "")


def normalize_symbol(raw: Column) -> Column:
    """Drop the address offset, clone mark, compiler suffix, cold mark and Rust hash, in that order."""
    symbol = strip_address_offset(raw)
    symbol = F.regexp_replace(symbol, r" \[clone\]$", "")
    symbol = F.regexp_replace(symbol, COMPILER_SUFFIX, "")
    symbol = F.regexp_replace(symbol, r"\.cold$", "")
    return F.regexp_replace(symbol, RUST_HASH, "")


def canonical_perf_event(event: Column) -> Column:
    """Strip event modifiers and hybrid-PMU wrapping; ``cpu-cycles`` means ``cycles``."""
    name = F.regexp_replace(event, EVENT_MODIFIER, "$1")
    return F.when(name == "cpu-cycles", F.lit("cycles")).otherwise(
        F.regexp_replace(name, PMU_EVENT, "$1")
    )


def perf_period_unit(event: Column) -> Column:
    name = canonical_perf_event(event)
    return (
        F.when(name.isin(*CLOCK_EVENTS), F.lit("nanoseconds"))
        .when(name.isin("cycles", "instructions"), name)
        .otherwise(F.lit("event_count"))
    )


def is_unknown_symbol(symbol: Column) -> Column:
    return symbol.isin(*UNKNOWN_SYMBOLS)


def percent(value: Column, total: Column) -> Column:
    """``100 * value / total`` to six places, half-even; 0 where the total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(
        F.bround(value.cast("double") * 100.0 / total.cast("double"), 6)
    )


def source_location(frame: Column) -> Column:
    """``file[:line[:column]]`` of a frame, null without a file."""
    file, line, column = frame["source_file"], frame["source_line"], frame["source_column"]
    return F.when(
        file.isNotNull(),
        F.concat(
            file,
            F.when(
                line.isNotNull(),
                F.concat(F.lit(":"), line, F.when(column.isNotNull(), F.concat(F.lit(":"), column)).otherwise("")),
            ).otherwise(""),
        ),
    )


def path_prefix_match(path: Column, prefix: Column) -> Column:
    """True when ``path`` is ``prefix`` or lies below it."""
    return (path == prefix) | F.startswith(path, F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/")))
