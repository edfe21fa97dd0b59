"""Redaction of labels and paths, and content digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what marks text as sensitive, and what replaces it
REDACTED = "[redacted]"
RAW_ADDRESS = r"^(?:0[xX][0-9a-fA-F]+|[0-9a-fA-F]{8,32})$"
CREDENTIAL = (
    r"(?i)(?:^|[\s?&;,])"
    r"(?:api[_-]?key|access[_-]?token|refresh[_-]?token|auth[_-]?token|"
    r"password|passwd|pwd|token|secret|client[_-]?secret|credentials?|authorization)"
    r"\s*(?:=|:\s+)\s*[^\s,;&]+"
)
URI_USERINFO = r"(?i)\b[a-z][a-z0-9+.-]*://[^\s/@]+(?::[^\s/@]*)?@"
PRIVATE_KEY = r"(?i)-----BEGIN(?: [A-Z0-9]+)* PRIVATE KEY(?: BLOCK)?-----"
CONTROL = r"[\x00-\x1f\x7f]"
ABSOLUTE = r"^(?:/|\\\\|[A-Za-z]:[\\/])"


def is_sensitive(text: Column) -> Column:
    """Empty or control text, raw addresses, credentials, URI user info, private keys."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (
        (trimmed == "")
        | text.rlike(CONTROL)
        | trimmed.rlike(RAW_ADDRESS)
        | trimmed.rlike(CREDENTIAL)
        | trimmed.rlike(URI_USERINFO)
        | trimmed.rlike(PRIVATE_KEY)
    )


def redact_label(text: Column) -> Column:
    """``text``, or the mark when it is sensitive or an absolute path."""
    return F.when(is_sensitive(text) | F.trim(text).rlike(ABSOLUTE), REDACTED).otherwise(text)


def redact_path(text: Column) -> Column:
    """The last part of a path, or the mark when path or part is sensitive."""
    leaf = F.element_at(F.split(F.replace(text, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(is_sensitive(text) | leaf.isin("", ".", "..") | is_sensitive(leaf), REDACTED).otherwise(leaf)


def path_digest(path: Column) -> Column:
    """What stands for a path that may not be shown."""
    return F.sha2(F.encode(path, "UTF-8"), 256)


def workspace_relative(path: Column, root: Column) -> Column:
    """The part of ``path`` below ``root``, null outside of it."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1))


def map_sources(locations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace source paths by workspace paths: left join on (path digest, line).

    ``locations``: ``source_file, source_line``; ``mapping``: ``path_digest, source_line,
    workspace_path``.  Unmapped paths keep only their digest.
    """
    keyed = locations.withColumn("path_digest", path_digest(F.col("source_file")))
    return keyed.join(mapping, ["path_digest", "source_line"], "left").withColumn(
        "source_file", F.coalesce("workspace_path", F.concat(F.lit("sha256:"), F.col("path_digest")))
    ).drop("workspace_path")


def map_prefixes(paths: DataFrame, column: str, prefixes: list[tuple[str, str]]) -> DataFrame:
    """Add ``mapped_path``: the first listed (source prefix, destination) that fits.

    The list is a setting of the caller, so it becomes one expression instead of a join.
    """
    from gristmill.functions.symbols import path_prefix_match

    path, mapped = F.col(column), None
    for source, destination in prefixes:
        root = source.rstrip("/")
        moved = F.concat(F.lit(destination.rstrip("/")), F.substr(path, F.lit(len(root) + 1)))
        fits = path_prefix_match(path, F.lit(root or "/"))
        mapped = F.when(fits, moved) if mapped is None else mapped.when(fits, moved)
    return paths.withColumn("mapped_path", path if mapped is None else mapped.otherwise(path))


def canonical_json(columns: list[str]) -> Column:
    """JSON of the named columns in name order; nulls are left out."""
    return F.to_json(F.struct(*sorted(columns)))


def content_digest(columns: list[str]) -> Column:
    return F.sha2(F.encode(canonical_json(columns), "UTF-8"), 256)
