"""Slow-log text to entries, with the rejected ones and their reasons.

A log is cut at its time headers into chunks, and a chunk begins an entry unless the entry before it is still open (a header
inside a statement is a forgery). Whether a chunk leaves its entry closed depends on it alone once that is known, so a chunk is a
function on two states, and a block of a file is one, too. Blocks are read by tasks of their own: what lies between two sure
beginnings stays in the task, only the chunks at a block's borders are put in order by file and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Longest plausible duration in ms, bytes of a statement that end it at the next header, lengths of names, and what leads the monitor's own statements.
DAY_MS, BODY_BYTES, NAME_BYTES, HOST_BYTES, OWN_TAG = 86_400_000, 1 << 20, 96, 255, "/* querywatch:"

HEAD = r"^[^\n]*(?:\n[ \t\r]*(?:#[^\n]*|(?:use|USE) [^\n]*)?(?=\n|$))*"  # the rest of the time line, comments, the schema and blank lines
STAMP = r"^\n?SET timestamp=[^\n]*"
PARTS = "file string, block bigint, nth int, whole boolean, sure boolean, as_first boolean, as_later boolean, chunk string"


def _body(chunk: Column) -> tuple[Column, Column]:
    """(what follows the header, the statement in it)."""
    rest = F.regexp_replace(chunk, HEAD, "")
    return rest, F.regexp_replace(rest, STAMP, "")


def _ends(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "").endswith(";")


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PARTS: entries that lie within a block whole, and the chunks at its borders. One entry is in memory at a time.

    as_first and as_later say whether a chunk leaves its entry closed if it begins one, or goes on with one. Both ways are
    followed from a block's first chunk on until they agree; from the next sure beginning on entries are known.
    """
    names = [x.split(" ")[0] for x in PARTS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
    at, nth, states, entry, out = None, 0, (True, False), None, []

    def end() -> None:
        """The last entry of a block may go on in the next one."""
        nonlocal entry, nth
        if entry is not None:
            out.append((*at, nth, False, True, states[0], states[0], "\n# Time:".join(entry)))
        entry, nth = None, 0

    for batch in batches:
        for file, block, chunk, as_first, as_later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != at:
                end()
                at, states = (file, block), (True, False)
                if block == 0:
                    states = (True, True)  # nothing is open where a file begins
                    if not chunk.startswith("# Time:"):
                        continue  # a banner
            known = states[0] == states[1]
            if known and states[0]:
                if entry is not None:
                    out.append((*at, nth, True, True, True, True, "\n# Time:".join(entry)))
                    nth += 1
                entry, states = [chunk], (as_first, as_first)
            elif known and entry is not None:
                entry.append(chunk)
                states = (as_later, as_later)
            else:
                out.append((*at, nth, False, False, as_first, as_later, chunk))
                nth += 1
                states = tuple(as_first if closed else as_later for closed in states)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)
            out = []
    if at is not None:
        end()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)


def read_slowlog(spark: SparkSession, path: str, min_ms: int = 0, monitor_user: str | None = None, tag: str = OWN_TAG) -> DataFrame:
    """One row per entry; ``reason`` is null for accepted ones, and what stands before a file's first header is dropped.

    A header counts if no statement is open: one is open from its first line (or SET timestamp) until a line ends in a semicolon,
    or a chunk of it is longer than BODY_BYTES. One file takes as many tasks as it has blocks. The log is read twice, once for the entries within
    blocks and once for the few chunks at their borders; neither text nor entries are shuffled but those few.
    """
    chunks = spark.read.text(path, lineSep="\n# Time:")
    rest, body = _body(F.col("value"))
    long = F.octet_length("value") > BODY_BYTES
    rows = chunks.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", ((rest == "") | _ends(body) | long).alias("as_first"), (_ends(F.col("value")) | long).alias("as_later"))
    parts = rows.mapInArrow(_in_blocks, PARTS)
    within = parts.filter("whole").select("chunk")

    # At the borders a chunk that may or may not close its entry keeps what was, or turns it round: what it leaves is what the
    # last chunk with one answer has left, turned round as often as there are such chunks since.
    w = Window.partitionBy("file").orderBy("block", "nth")
    turns = F.sum(F.when(~F.col("sure") & ~F.col("as_first") & F.col("as_later"), 1).otherwise(0)).over(w)
    border = parts.filter("NOT whole").withColumn("turns", turns)
    one = F.col("sure") | (F.col("as_first") == F.col("as_later"))
    border = border.withColumn("known", F.last(F.when(one, F.struct(F.col("as_first").alias("closed"), "turns")), ignorenulls=True).over(w))
    odd = (F.col("turns") - F.coalesce("known.turns", F.lit(0))) % 2 == 1
    border = border.withColumn("closed", F.coalesce("known.closed", F.lit(True)) != odd)
    begins = F.col("sure") | F.coalesce(F.lag("closed").over(w), F.lit(True))
    entries = border.withColumn("begins", begins.cast("int")).withColumn("entry", F.sum("begins").over(w)).groupBy("file", "entry")
    across = entries.agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "nth", "chunk")))["chunk"], "\n# Time:").alias("chunk"))
    return parse_entries(within.unionByName(across.select("chunk")), min_ms, monitor_user, tag)


def parse_entries(chunks: DataFrame, min_ms: int = 0, monitor_user: str | None = None, tag: str = OWN_TAG) -> DataFrame:
    """Entries of chunks, each from behind its "# Time:". Names that are no plain identifiers are null; fields come from the header alone."""
    head = F.regexp_extract(F.col("chunk"), HEAD, 0)
    _, body = _body(F.col("chunk"))
    rows = chunks.select(head.alias("head"), F.regexp_replace(F.regexp_replace(body, r"^\s+|[\s;]+$", ""), r"\r\n", "\n").alias("sql_text"))
    get = lambda p: F.nullif(F.trim(F.regexp_extract("head", p, 1)), F.lit(""))
    who = r"(?m)^\s*# User@Host:"
    stamp = get(r"^(?:# Time:)?\s*(\S[^\n]*)")
    zoned = F.when(stamp.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|\+\d\d:\d\d)$"), stamp)
    seconds = lambda name: F.round(F.when(get(rf"{name}:\s*(\S+)").rlike(r"^[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?$"), get(rf"{name}:\s*(\S+)")).try_cast("double") * 1000).cast("bigint")
    whole = lambda name: get(rf"{name}:\s*(\d+)(?!\S)").try_cast("bigint")
    plain = lambda c, more, most: F.when(c.rlike(rf"^[A-Za-z0-9_\-.{more}]+$") & (F.length(c) <= most), c)
    host = F.coalesce(get(rf"{who}[^\n@]*@\s*([^\[\n]*?)\s*(?:\[|Id:|$)"), get(rf"{who}[^\n@]*@[^\[\n]*\[([^\]\n]*)\]"))
    out = rows.select(
        F.unix_millis(F.try_to_timestamp(zoned)).alias("ended_at_ms"), seconds("Query_time").alias("duration_ms"), F.least(F.coalesce(seconds("Lock_time"), F.lit(0)), F.lit(DAY_MS)).alias("lock_time_ms"),
        get(rf"{who}[^\n]*?Id:\s*(\d+)(?!\S)").try_cast("bigint").alias("thread_id"), plain(get(rf"{who}([^\[\n]*)"), "$", NAME_BYTES).alias("db_user"), plain(host, r":\[\]", HOST_BYTES).alias("db_host"),
        plain(get(r"(?m)^\s*(?:use|USE) ([^;\n]*)"), "$", NAME_BYTES).alias("schema_name"), whole("Rows_sent").alias("rows_sent"), whole("Rows_examined").alias("rows_examined"), whole("Rows_affected").alias("rows_affected"), "sql_text", "head",
    )
    started = F.col("ended_at_ms") - F.col("duration_ms")
    own = F.coalesce(F.col("db_user") == F.lit(monitor_user), F.lit(False)) | F.col("sql_text").startswith(tag)
    reason = (
        F.when(F.col("head").contains("administrator command:"), "admin_command").when(F.col("ended_at_ms").isNull(), "bad_timestamp").when(F.col("duration_ms").isNull() | F.col("thread_id").isNull(), "missing_header")
        .when(~F.col("duration_ms").between(0, DAY_MS) | (started < 0), "implausible_duration").when(F.col("sql_text") == "", "empty_sql").when(F.col("duration_ms") < min_ms, "below_threshold").when(own, "own_statement")
    )
    return out.withColumn("reason", reason).withColumn("started_at_ms", started).drop("head")
