"""Flight-recorder documents of any size: one JSON array, cut into elements by many tasks.

A document is ``{"recording": {"events": [ ... ]}}``, often on one line, so it cannot be split at line ends.
It is read in pieces between commas, which every split of the file gives by itself.  Whether a piece starts
inside a string depends on the number of quotes before it, and how deep it is nested on the brackets before
it: both are running sums, scanned per chunk of pieces with the sums of the chunks carried over.  A comma at the
depth of the array ends an element, and the pieces of an element are put together again.  No task holds a
document, only elements and chunks of pieces; only numbers are scanned over the chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.ordered import cut, cut_texts, dense_index, running, running_sum
from gristmill.sources.adapters import JFR_EVENT, JFR_EVENTS, jfr_duration_ns, jfr_time_ns, jfr_waits

# fixed values: the frame of a document, the fields of each event, all field names, the depth of the array
PREFIX = r'^\s*\{\s*"recording"\s*:\s*\{\s*"events"\s*:\s*\['
SUFFIX = r"\]\s*\}\s*\}\s*$"
DEPTH = 3
# pieces are handled in chunks of 2^8, so that their texts are shuffled in bulk
CHUNK_BITS = 8
_WAIT_FIELDS = ("startTime", "duration", "eventThread", "stackTrace", "address")
FIELDS = {
    "jdk.JavaMonitorEnter": (*_WAIT_FIELDS, "monitorClass", "previousOwner"),
    "jdk.JavaMonitorWait": (*_WAIT_FIELDS, "monitorClass", "notifier", "timedOut", "timeout"),
    "jdk.ThreadPark": (*_WAIT_FIELDS, "parkedClass", "timeout", "until"),
    "jdk.DataLoss": ("startTime", "amount", "total"),
}
JVM_REQUIRED = ("startTime", "jvmName", "jvmVersion", "jvmStartTime", "pid")
JVM_OPTIONAL = ("jvmArguments", "jvmFlags", "javaArguments")
NAMES = (
    "address amount bytecodeIndex classLoader descriptor duration eventThread exported frames group hidden javaName javaArguments javaThreadId "
    "jvmArguments jvmFlags jvmName jvmStartTime jvmVersion lineNumber location method modifiers module monitorClass name notifier osName osThreadId "
    "package parent parkedClass pid previousOwner stackTrace startTime timedOut timeout total truncated type until values version virtual"
).split()
JVM_VERSION = r"\bJRE \(((?:17|21|25)\.[A-Za-z0-9.+_-]+)\)"
MAX_FRAMES = 127


@dataclass(frozen=True)
class JfrDocuments:
    """``captures`` (one row per document with its verdict), ``problems`` (bad elements), ``elements``.

    ``elements``: ``capture_id, source_index, text`` and the parsed ``event``.
    """

    captures: DataFrame
    problems: DataFrame
    elements: DataFrame


def read_pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, piece_no, piece): the texts between commas of each file, read by as many tasks as it has splits."""
    rows = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("piece")
    )
    return dense_index(rows, ["path"], ["row"], F.col("block"), "piece_no").select("path", "piece_no", "piece")


def pieces_of(documents: DataFrame) -> DataFrame:
    """``read_pieces`` of documents that stand in a column, ``capture_id, document``."""
    parts = documents.select("capture_id", F.posexplode(F.split("document", ",")).alias("n", "piece"))
    return parts.select("capture_id", F.col("n").cast("long").alias("piece_no"), "piece")


def _count(text: Column, letters: str) -> Column:
    """How many of ``letters`` are in ``text``."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def _nothing_quoted(bare: Column, inside: bool) -> Column:
    """What stands outside of strings, where the text begins ``inside`` one or not."""
    return F.regexp_replace(F.regexp_replace(bare, '^[^"]*"?', "") if inside else bare, '"[^"]*"?', "")


def _steps(plain: Column) -> Column:
    return _count(plain, "{[") - _count(plain, "}]")


def _before(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Add sums over the earlier chunks of the document."""
    return running(rows, ["capture_id"], "chunk", {name: running_sum(value, inclusive=False) for name, value in sums.items()})


def _fragments(pieces: DataFrame) -> DataFrame:
    """Pieces put together as far as they are of one element and one chunk.

    ``capture_id, chunk, local`` (number of the element within the chunk), ``text``, ``ended`` (the element ends here),
    ``last``, ``depth`` at the end and ``closings``, how often the array was closed within the chunk so far.
    """
    chunk = F.shiftright("piece_no", CHUNK_BITS).alias("chunk")
    chunks = pieces.groupBy("capture_id", chunk).agg(F.sort_array(F.collect_list(F.struct("piece_no", "piece"))).alias("ps"))
    chunks = cut_texts(chunks.select("capture_id", "chunk", F.transform("ps", lambda p: p["piece"]).alias("ps")))
    # an escape never spans a comma; what a chunk adds to the depth is counted for both ways it may begin
    bare = chunks.select("capture_id", "chunk", F.regexp_replace(F.array_join("ps", ","), r"(?s)\\.", "").alias("bare"))
    starts = cut(
        bare.select(
            "capture_id", "chunk", _count(F.col("bare"), '"').alias("quotes"),
            *[_steps(_nothing_quoted(F.col("bare"), inside)).alias(f"step_{inside:d}") for inside in (False, True)],
        )
    )
    starts = _before(starts, {"quotes_first": F.col("quotes")})
    starts = cut(starts.withColumn("step", F.when(F.col("quotes_first") % 2 == 1, F.col("step_1")).otherwise(F.col("step_0"))))
    starts = _before(starts, {"depth_first": F.col("step")}).select("capture_id", "chunk", "quotes_first", "depth_first")
    ends = starts.groupBy("capture_id").agg(F.max("chunk").alias("last_chunk"))
    starts = cut(starts.join(ends, "capture_id").withColumn("last_chunk", F.col("chunk") == F.col("last_chunk")))
    rows = chunks.join(starts, ["capture_id", "chunk"]).withColumn("last_n", F.size("ps") - 1)
    rows = rows.select("capture_id", "chunk", "quotes_first", "depth_first", "last_chunk", "last_n", F.posexplode("ps").alias("n", "piece"))
    # the rows of a chunk are together already, so these windows shuffle nothing
    order = Window.partitionBy("capture_id", "chunk").orderBy("n")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    rows = rows.withColumn("bare", F.regexp_replace("piece", r"(?s)\\.", "")).withColumn("quotes", _count(F.col("bare"), '"'))
    rows = rows.withColumn("quotes_before", F.col("quotes_first") + F.coalesce(F.sum("quotes").over(before), none))
    inside = F.col("quotes_before") % 2 == 1
    rows = rows.withColumn("plain", F.when(inside, _nothing_quoted(F.col("bare"), True)).otherwise(_nothing_quoted(F.col("bare"), False)))
    rows = rows.select(
        "capture_id", "chunk", "n", "piece", "depth_first", (F.col("last_chunk") & (F.col("n") == F.col("last_n"))).alias("last"), _steps(F.col("plain")).alias("step"),
        # nothing opens behind a closing bracket without a comma between them: there the document has ended
        F.col("plain").rlike(r"(?s)[}\]].*[{\[]").alias("reopened"), ((F.col("quotes_before") + F.col("quotes")) % 2 == 1).alias("in_string"),
    )
    rows = rows.withColumn("depth", F.col("depth_first") + F.sum("step").over(upto))
    # once the array is closed, nothing more is an element
    rows = rows.withColumn("closings", F.sum(F.when((F.col("depth") < DEPTH) | F.col("reopened"), 1).otherwise(0).cast("long")).over(upto))
    rows = rows.withColumn("ends", (F.col("depth") == DEPTH) & (F.col("closings") == 0) & ~F.col("in_string") & ~F.col("last"))
    rows = rows.withColumn("local", F.coalesce(F.sum(F.col("ends").cast("long")).over(before), none))
    return cut_texts(
        rows.groupBy("capture_id", "chunk", "local").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "piece"))), lambda p: p["piece"]), ",").alias("text"),
            F.bool_or("ends").alias("ended"),
            F.bool_or("last").alias("last"),
            F.max(F.when(F.col("last"), F.col("depth"))).alias("depth"),
            F.max("closings").alias("closings"),
        )
    )


def elements(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, frames) of ``capture_id, piece_no, piece``.

    ``elements``: ``capture_id, source_index, text``.  ``frames``: one row per document, ``prefix_ok``, ``suffix_ok``,
    ``closed`` (all brackets are), ``events``.  The last element of a document that breaks off is what is left of it.
    """
    fragments = _fragments(pieces)
    starts = cut(fragments.groupBy("capture_id", "chunk").agg(F.count_if("ended").alias("ends"), F.max("closings").alias("closed")))
    starts = cut(_before(starts, {"closed_first": F.col("closed")}))
    still_open = F.col("closed_first") == 0
    starts = cut(_before(starts, {"ends_first": F.when(still_open, F.col("ends")).otherwise(0)}).select("capture_id", "chunk", "closed_first", "ends_first"))
    rows = fragments.join(starts, ["capture_id", "chunk"]).select(
        "capture_id", (F.col("ends_first") + F.when(still_open, F.col("local")).otherwise(0)).alias("source_index"), "chunk", "local", "text", "last",
        F.col("depth").alias("end_depth"), (F.col("closed_first") + F.col("closings")).alias("closings"), (still_open & (F.col("local") > 0) & F.col("ended")).alias("whole"),
    )
    # elements that begin and end within a chunk are whole; only the others are put together
    broken = rows.where(~F.col("whole")).groupBy("capture_id", "source_index").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "local", "text"))), lambda p: p["text"]), ",").alias("text"),
        F.bool_or("last").alias("last"),
        F.max("end_depth").alias("end_depth"),
        F.max("closings").alias("closings"),
    )
    joined = rows.where("whole").select(*broken.columns).unionByName(broken)
    first = F.col("source_index") == 0
    marked = joined.withColumn("prefix_ok", F.when(first, F.col("text").rlike(PREFIX))).withColumn("suffix_ok", F.when(F.col("last"), F.col("text").rlike(SUFFIX) & (F.col("closings") == 1)))
    text = F.when(first, F.regexp_replace("text", PREFIX, "")).otherwise(F.col("text"))
    text = F.when(F.col("last"), F.regexp_replace(text, SUFFIX, "")).otherwise(text)
    marked = cut_texts(marked.withColumn("text", F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))))
    frames = marked.groupBy("capture_id").agg(
        F.bool_and("prefix_ok").alias("prefix_ok"),
        F.bool_and("suffix_ok").alias("suffix_ok"),
        (F.max("end_depth") == 0).alias("closed"),
        F.count(F.lit(1)).alias("events"),
        F.bool_and(F.col("text") == "").alias("no_text"),
    )
    none = (F.col("events") == 1) & F.col("no_text") & F.col("prefix_ok") & F.col("suffix_ok")
    frames = frames.select("capture_id", "prefix_ok", "suffix_ok", "closed", F.when(none, 0).otherwise(F.col("events")).alias("events"))
    kept = marked.join(frames.where("events = 0").select("capture_id"), "capture_id", "left_anti")
    return kept.select("capture_id", "source_index", "text", "last"), frames


def _thread_ok(thread: Column, text: Column, major: Column) -> Column:
    """A thread is null, or has its fields, an id, and from JDK 21 on the mark of virtual threads."""
    keys = F.json_object_keys(text)
    needed = F.array(*[F.lit(n) for n in ("osName", "osThreadId", "javaName", "javaThreadId", "group")])
    known = F.array(*[F.lit(n) for n in ("osName", "osThreadId", "javaName", "javaThreadId", "group", "virtual")])
    shape = (F.size(F.array_except(needed, keys)) == 0) & (F.size(F.array_except(keys, known)) == 0)
    real = (thread["javaThreadId"] > 0) & (F.coalesce(thread["virtual"], F.lit(False)) | (thread["osThreadId"] > 0))
    return text.isNull() | F.coalesce(shape & real & ((major == 17) | thread["virtual"].isNotNull()), F.lit(False))


_EXTRA = "struct<total: bigint, pid: bigint, jvmName: string, jvmVersion: string, jvmStartTime: string>"


def read_documents(pieces: DataFrame, targets: DataFrame) -> JfrDocuments:
    """Judge whole documents, given in pieces ``capture_id, piece_no, piece``.

    ``targets``: one row per capture, ``target_pid, jdk_major, threshold_ns``.  A document is taken as a whole or
    not at all; ``captures`` names its first problem (``reason``, ``source_index``).  Further columns: ``events``,
    ``waits``, ``lost_bytes``, ``runtime_version``, ``truncated_stacks``, ``empty_stacks``, ``truncated``.
    Field names are checked at every depth, the fields of an event and of its threads exactly, classes and frames
    by the fields that are read.
    """
    c = F.col
    parts, frames = elements(pieces)
    limits = targets.select("capture_id", "target_pid", "jdk_major", "threshold_ns")
    rows = parts.join(frames.select("capture_id", "suffix_ok", "closed"), "capture_id").join(limits, "capture_id", "left")
    values = F.get_json_object("text", "$.values")
    rows = rows.select(
        "*", F.from_json("text", JFR_EVENT).alias("event"), F.from_json(values, _EXTRA).alias("extra"), F.json_object_keys("text").alias("outer"), F.json_object_keys(values).alias("keys"),
        *[F.get_json_object(values, f"$.{t}").alias(t) for t in ("eventThread", "previousOwner", "notifier")],
    )
    e, v, x = c("event"), c("event")["values"], c("extra")
    named = F.regexp_extract_all(F.regexp_replace("text", r"(?s)\\.", ""), F.lit(r'"([^"]*)"\s*:'), 1)
    wait = e["type"].isin(*JFR_EVENTS)
    expected = F.array().cast("array<string>")
    for kind, fields in FIELDS.items():
        expected = F.when(e["type"] == kind, F.array(*map(F.lit, fields))).otherwise(expected)
    exact = (F.size(F.array_except("keys", expected)) == 0) & (F.size(F.array_except(expected, c("keys"))) == 0)
    jvm_needed, jvm_known = F.array(*map(F.lit, JVM_REQUIRED)), F.array(*map(F.lit, JVM_REQUIRED + JVM_OPTIONAL))
    jvm = (F.size(F.array_except(jvm_needed, "keys")) == 0) & (F.size(F.array_except("keys", jvm_known)) == 0) & (x["pid"] > 0) & (F.length(x["jvmName"]) > 0)
    lasted = jfr_duration_ns(v["duration"])
    stack = F.coalesce(F.size(v["stackTrace"]["frames"]), F.lit(0))
    threads = [_thread_ok(v[t], F.nullif(c(t), F.lit("null")), c("jdk_major")) for t in ("eventThread", "previousOwner", "notifier")]
    broken_off = c("last") & ~c("suffix_ok")
    reason = (
        F.when(broken_off & c("closed"), "TRAILING_FIELDS").when(broken_off, "TRUNCATED")
        .when(c("text") == "", "EMPTY_ELEMENT")
        .when(~c("text").startswith("{") | c("outer").isNull(), "NOT_AN_OBJECT")
        .when(F.size(F.array_except(named, F.array(*map(F.lit, NAMES)))) > 0, "UNKNOWN_FIELD")
        .when((F.size("outer") != 2) | ~F.array_contains("outer", "type") | ~F.array_contains("outer", "values") | c("keys").isNull(), "INVALID_EVENT")
        .when(e["type"] == "jdk.JVMInformation", F.when(~F.coalesce(jvm, F.lit(False)), "INVALID_EVENT").when(x["pid"] != c("target_pid"), "OTHER_PROCESS").when(_jdk(x["jvmVersion"]) != c("jdk_major"), "OTHER_RUNTIME"))
        .when(e["type"] == "jdk.DataLoss", F.when(~F.coalesce(exact & (v["amount"] >= 0) & (x["total"] >= v["amount"]), F.lit(False)), "INVALID_EVENT"))
        .when(~F.coalesce(wait & exact & (v["address"] >= 0) & (stack <= MAX_FRAMES) & v["startTime"].isNotNull() & v["duration"].isNotNull() & v["eventThread"].isNotNull(), F.lit(False)), "INVALID_EVENT")
        .when(~(threads[0] & threads[1] & threads[2]), "INVALID_THREAD")
        .when(jfr_time_ns(v["startTime"]).isNull(), "INVALID_TIME")
        .when(lasted.isNull(), "INVALID_DURATION")
        .when(lasted < c("threshold_ns"), "BELOW_THRESHOLD")
    )
    judged = cut_texts(rows.withColumn("reason", reason).drop("outer", "keys", "eventThread", "previousOwner", "notifier", "closed"))
    versions = judged.where((e["type"] == "jdk.JVMInformation") & c("reason").isNull())
    second = versions.join(versions.groupBy("capture_id").agg(F.min("source_index").alias("first")), "capture_id").where("source_index > first")
    problems = judged.where("reason is not null").select("capture_id", "source_index", "reason")
    problems = problems.unionByName(second.select("capture_id", "source_index", F.lit("SECOND_RUNTIME").alias("reason")))
    problems = cut(problems.unionByName(frames.where(~c("prefix_ok")).select("capture_id", F.lit(0).cast("long").alias("source_index"), F.lit("NOT_A_RECORDING").alias("reason"))))
    # a document that does not start as one is nothing else either
    worst = problems.groupBy("capture_id").agg(F.min(F.struct("source_index", F.when(c("reason") == "NOT_A_RECORDING", 0).otherwise(1).alias("k"), "reason")).alias("worst"))
    trace = v["stackTrace"]
    counted = judged.groupBy("capture_id").agg(
        F.count_if(wait).alias("waits"),
        F.sum(F.when(e["type"] == "jdk.DataLoss", v["amount"]).otherwise(0)).alias("lost_bytes"),
        F.max(F.when(e["type"] == "jdk.JVMInformation", _version(x["jvmVersion"]))).alias("runtime_version"),
        F.count_if(wait & trace["truncated"]).alias("truncated_stacks"),
        F.count_if(wait & trace.isNotNull() & (F.size(trace["frames"]) == 0)).alias("empty_stacks"),
    )
    captures = frames.join(counted, "capture_id", "left").join(worst, "capture_id", "left").fillna(0, ["waits", "lost_bytes", "truncated_stacks", "empty_stacks"])
    partial = (c("waits") > 0) & ((c("lost_bytes") > 0) | (c("truncated_stacks") > 0) | (c("empty_stacks") > 0))
    captures = captures.select(
        "capture_id", c("worst").isNull().alias("accepted"), c("worst.reason").alias("reason"), c("worst.source_index").alias("source_index"), "events", "waits",
        "lost_bytes", "runtime_version", "truncated_stacks", "empty_stacks", partial.alias("truncated"),
    )
    return JfrDocuments(captures, problems, judged.select("capture_id", "source_index", "text", "event", "target_pid"))


def _version(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, JVM_VERSION, 1), F.lit(""))


def _jdk(text: Column) -> Column:
    """Major version of a runtime, 0 where none of the known ones is named."""
    return F.coalesce(F.split(_version(text), r"\.")[0].try_cast("int"), F.lit(0))


def document_waits(documents: JfrDocuments) -> DataFrame:
    """Waits of the accepted documents as raw events of the runtime-lock reader."""
    whole = documents.captures.where("accepted").select("capture_id")
    rows = documents.elements.join(whole, "capture_id", "left_semi")
    return jfr_waits(rows.select("capture_id", "target_pid", "source_index", "event"))
