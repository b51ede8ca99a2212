"""Slow logs in any number of blocks, and entries by hand."""

import random

import pytest
from pyspark.sql import functions as F

from querywatch.sources import slowlog

HEAD = "# User@Host: app[app] @ web1 [10.0.0.1]  Id:    {id}\n# Query_time: 2.500000  Lock_time: 0.100000 Rows_sent: 3  Rows_examined: {id}\n"


def entry(n, body, time="2024-05-01T10:00:00.000000Z", head=HEAD, stamp="SET timestamp=1714557600;\n"):
    return f"# Time: {time}\n{head.format(id=n)}{stamp}{body}\n"


def plain(text):
    """Chunks of a log, line by line: a header counts if nothing is open."""
    out, current, body, inside = [], None, [], False
    for line in text.split("\n"):
        closed = not inside or (body and body[-1].rstrip().endswith(";"))
        if line.startswith("# Time:") and (current is None or closed):
            if current is not None:
                out.append("\n".join(current))
            current, body, inside = [line], [], False
            continue
        if current is None:
            continue
        current.append(line)
        bare = line.strip()
        if not inside:
            if not bare or bare.startswith("#") or bare.lower().startswith("use ") and bare[:4] in ("use ", "USE "):
                continue
            inside = True
            if bare.startswith("SET timestamp="):
                continue
        if bare or body:
            body = [*body, line] if bare else body
    if current is not None:
        out.append("\n".join(current))
    return out


def log(seed, n=60):
    """Entries of one and many chunks: forged headers that close, that do not, and that turn the state round; banners and empty bodies."""
    r, parts = random.Random(seed), ["banner text\nport: 3306\n"] if seed % 2 else []
    forged = "# Time: 2024-05-01T10:00:01Z\n"
    for k in range(n):
        body = r.choice([
            "select 1;", "select 'a\n" + forged + "b' from t;", "select 'a\n" + forged * 3 + "' ;", "select 1", "insert into t\nvalues (1),\n(2);", "select ';\n" + forged + "x'\n" + forged + "SET timestamp=5;\n" + forged + "y;",
            "-- c;\nselect 2;", "# only a comment", ";", "call p(); "])
        parts.append(entry(k, body, stamp=r.choice(["SET timestamp=1714557600;\n", ""])))
    return "".join(parts)


@pytest.mark.parametrize("block", [1 << 20, 900, 211, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_any_number_of_blocks_gives_the_same_entries(spark, tmp_path, seed, block):
    texts = [log(seed), log(seed + 10), "", "no header at all\n"]
    for i, text in enumerate(texts):
        (tmp_path / f"slow{i}.log").write_text(text)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    was = [spark.conf.get(n, None) for n in names]
    try:
        for n, v in zip(names, (str(block), "1", "1")):
            spark.conf.set(n, v)
        rows = slowlog.read_slowlog(spark, str(tmp_path), 0)
        tasks = spark.read.text(str(tmp_path), lineSep="\n# Time:").rdd.getNumPartitions()
        got = sorted((str(r["thread_id"]), r["sql_text"], r["reason"] or "") for r in rows.collect())
    finally:
        for n, v in zip(names, was):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    chunks = [c.removeprefix("# Time:").rstrip("\n") for t in texts for c in plain(t)]
    want = slowlog.parse_entries(spark.createDataFrame([(c,) for c in chunks], "chunk string"))
    assert got == sorted((str(r["thread_id"]), r["sql_text"], r["reason"] or "") for r in want.collect())
    assert len(got) == len(chunks) > 60 and (tasks > 20 or block > 900)


CASES = [
    (entry(1, "select 'x' from t;"), dict(reason=None, sql_text="select 'x' from t", thread_id=1, db_user="app", db_host="web1", duration_ms=2500, lock_time_ms=100, rows_sent=3, rows_examined=1)),
    (entry(2, "select 1;", time="2024-05-01T10:00:00"), dict(reason="bad_timestamp")),
    (entry(3, "select 1;", time="2024-05-01T12:00:00+02:00"), dict(reason=None, ended_at_ms=1714557600000, started_at_ms=1714557597500)),
    (entry(4, "", head="# administrator command: Quit;\n", stamp=""), dict(reason="admin_command")),
    (entry(5, "select 1;", head="# User@Host: app[app] @ web1 []  Id: 5\n"), dict(reason="missing_header")),
    (entry(6, "select 1;", head="# Query_time: 1.0  Lock_time: 0\n"), dict(reason="missing_header")),
    (entry(7, ";"), dict(reason="empty_sql")),
    (entry(8, "/* querywatch:rerun */ select 1;"), dict(reason="own_statement")),
    (entry(9, "select 1;", head=HEAD.replace("app[app]", "mon[mon]")), dict(reason="own_statement")),
    (entry(10, "select 1;", head=HEAD.replace("app[app] @ web1", "bad name[x] @ we b")), dict(reason=None, db_user=None, db_host=None)),
    (entry(11, "select 1;", head=HEAD.replace("@ web1 [", "@  [")), dict(reason=None, db_host="10.0.0.1")),
    (entry(12, "select 1;", head=HEAD.replace("2.500000", "90000.0")), dict(reason="implausible_duration")),
    (entry(13, "select 1;", head=HEAD.replace("2.500000", "0.2")), dict(reason="below_threshold")),
    (entry(14, "select 1;", head=HEAD.replace("2.500000", "-1")), dict(reason="missing_header")),
    (entry(15, "select a,\n  b -- x\nfrom t\nwhere c = '# Query_time: 9';", head=HEAD + "use shop;\n# Rows_affected: 7\n"), dict(reason=None, sql_text="select a,\n  b -- x\nfrom t\nwhere c = '# Query_time: 9'", schema_name="shop", rows_affected=7, duration_ms=2500)),
    (entry(16, "select 1;", time="1970-01-01T00:00:01Z"), dict(reason="implausible_duration")),
]


def test_entries_by_hand(spark):
    chunks = spark.createDataFrame([(i, text.removeprefix("# Time:").rstrip("\n")) for i, (text, _) in enumerate(CASES)], "i int, chunk string")
    for i, (_, want) in enumerate(CASES):
        row = slowlog.parse_entries(chunks.filter(F.col("i") == i), 1000, "mon").first().asDict()
        assert {k: row[k] for k in want} == want, i
