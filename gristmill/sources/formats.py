"""Formats by name: what a format has to give so that its captures go through every operator.

A format is a function from lines to rows.  Reading files, naming captures, numbering lines and choosing captures
is the same for all of them, so a format of one's own is one call of ``register``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.ordered import cut, dense_index
from gristmill.sources import folded, perf_script, stat
from gristmill.sources.lines import capture_of, read_lines

# fixed values: the columns that rows of each kind must have, with their types
KINDS = {
    "samples": {"capture_id": "string", "weight": "bigint", "event": "string", "weight_unit": "string", "weight_source": "string", "frames": None},
    "counters": {"capture_id": "string", "event": "string", "value": "double", "unit": "string", "status": "string"},
}


@dataclass(frozen=True)
class Format:
    """``parse`` maps ``capture_id, line`` rows to rows of ``kind``; with ``numbered`` they have ``line_no`` from 1 on,
    else ``sample_seq``, which orders the lines of a capture and costs no shuffle."""

    name: str
    kind: str
    parse: Callable[[DataFrame], DataFrame]
    numbered: bool


_FORMATS: dict[str, Format] = {}


def register(name: str, kind: str, parse: Callable[[DataFrame], DataFrame], numbered: bool = True) -> Format:
    """Enter a format; a name can be entered once."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known are {sorted(KINDS)}")
    if name in _FORMATS:
        raise ValueError(f"format {name!r} is registered already")
    _FORMATS[name] = Format(name, kind, parse, numbered)
    return _FORMATS[name]


def formats() -> dict[str, str]:
    """Names of the formats and the kind of rows each gives."""
    return {n: f.kind for n, f in sorted(_FORMATS.items())}


def list_captures(spark: SparkSession, path: str) -> DataFrame:
    """(capture_id, path, bytes) of the files below ``path``; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    return files.select(capture_of(F.col("path"), path).alias("capture_id"), "path", "bytes")


def read(spark: SparkSession, name: str, path: str, captures: Sequence[str] | None = None) -> DataFrame:
    """Rows of all files below ``path`` in the format ``name``; with ``captures`` only their files are read.

    A capture that is not there is an error.
    """
    if name not in _FORMATS:
        raise ValueError(f"unknown format {name!r}; known are {sorted(_FORMATS)}")
    form = _FORMATS[name]
    files: str | list[str] = path
    if captures is not None:
        # as many rows as captures were asked for
        found = {r["capture_id"]: r["path"] for r in list_captures(spark, path).where(F.col("capture_id").isin(list(captures))).collect()}
        missing = sorted(set(captures) - set(found))
        if missing:
            raise ValueError(f"no capture {missing} below {path}")
        if not found:
            return read(spark, name, path).limit(0)
        files = sorted(found.values())
    lines = read_lines(spark, files)
    capture = capture_of(F.col("path"), path).alias("capture_id")
    if form.numbered:
        lines = dense_index(lines, ["path"], ["row_id"], F.col("block_start"), "line_no").select(capture, (F.col("line_no") + 1).alias("line_no"), "line")
    else:
        lines = lines.select(capture, F.struct("block_start", "row_id").alias("sample_seq"), "line")
    return checked(form.parse(lines), form)


def checked(rows: DataFrame, form: Format) -> DataFrame:
    """``rows``, or an error that names the columns a format leaves out or gives in another type."""
    types = dict(rows.dtypes)
    wrong = [c if kind is None else f"{c} {kind}" for c, kind in KINDS[form.kind].items() if c not in types or kind not in (None, types[c])]
    if wrong:
        raise ValueError(f"format {form.name!r} gives no {', '.join(wrong)}")
    return rows


def _perf_script(lines: DataFrame) -> DataFrame:
    return perf_script.perf_samples(perf_script.perf_records(cut(perf_script.mark_lines(lines))))


register("folded", "samples", lambda lines: folded.full_samples(folded.folded_samples(folded.parse_folded(lines))), numbered=False)
register("perf-script", "samples", _perf_script)
register("perf-stat", "counters", lambda lines: stat.stat_metrics(stat.parse_stat(lines)))
