"""Plan documents without literals.

A document is cut at the strings that may hold literals: one streamed pass gives its fragments and those strings, each
with the rule for it. The strings are masked by Catalyst as statements are, and the fragments joined again around them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from querywatch.functions import query_text
from querywatch.plans.flatten import document

#: Keys whose strings stay, keys whose strings are expressions, keys whose strings are labels with expressions in
#: them, keys and endings of keys whose numbers are estimates, and what stands for a string that cannot be masked.
SAFE = (
    "access_type attached_subqueries cacheable column_name cost_info dependent eval_cost data_read_per_join filtered index_name key key_length possible_keys prefix_cost query_cost "
    "read_cost rows_examined_per_scan rows_produced_per_join select_id sort_cost table_name table_type using_MRR using_filesort using_index using_index_for_group_by using_join_buffer "
    "using_temporary_table partitions index_access_type"
).split()
EXPRESSIONS = (
    "attached_condition ranges condition used_columns used_key_parts query lookup_condition sort_fields index_condition pushed_condition having group_by_subqueries select_list_subqueries "
    "order_by_subqueries update_value_subqueries ref materialized_from_subquery_condition"
).split()
LABELS = ("operation", "heading")
ESTIMATES = (
    "select_id rows_examined_per_scan rows_produced_per_join rows_for_plan estimated_rows estimated_total_cost estimated_first_row_cost filtered key_length used_key_parts_count depth "
    "index_dives_for_eq_ranges chosen"
).split()
ESTIMATE_ENDS = ("_cost", "_per_join", "_per_scan")
REDACTED = "<redacted>"

LITERAL = r"""['"]|(?<![\p{L}\p{N}_$])[0-9]"""  # something in a string that may be one
WORD = r"[\p{L}_$@][\p{L}\p{N}_$@]*"
#: In a label: quoted and bare literals, parameters and hints; names and words are matched first, so that digits in them stay.
IN_LABEL = rf"""(?s)(`[^`]*`|{WORD})|/\*\+.*?\*/|'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*"|0[xX][0-9a-fA-F]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|\?"""
OPEN_LABEL = r"""['"]|/\*|--[ \t\n]|#"""  # what must not be left: an open quote, a comment
ODD_NAME = r"`[^`]*[^`\p{L}\p{N}_$][^`]*`"


class _Raw(str):
    """A number as it is written."""


def _cut(text: str | None) -> dict | None:
    """Fragments, the strings between them with their rules, and how many numbers were masked; None if it is no document."""
    doc = document(text, parse_int=_Raw, parse_float=_Raw, parse_constant=_Raw)
    if doc is None:
        return None
    fragments, leaves, numbers, now = [], [], 0, []

    def walk(v, key: str) -> None:
        nonlocal numbers, now
        if isinstance(v, dict):
            now.append("{")
            for i, (k, x) in enumerate(v.items()):
                now.append(f"{',' if i else ''}{json.dumps(k, ensure_ascii=False)}:")
                walk(x, k)
            now.append("}")
        elif isinstance(v, list):
            now.append("[")
            for i, x in enumerate(v):
                if i:
                    now.append(",")
                walk(x, key)
            now.append("]")
        elif isinstance(v, _Raw):
            estimate = key in ESTIMATES or key.endswith(ESTIMATE_ENDS)
            numbers += not estimate
            now.append(v if estimate else '"?"')
        elif isinstance(v, str) and key not in SAFE:
            leaves.append({"rule": "label" if key in LABELS else "expression" if key in EXPRESSIONS else "other", "text": v})
            fragments.append("".join(now))
            now = []
        else:
            now.append(json.dumps(v, ensure_ascii=False))

    walk(doc, "")
    return {"fragments": [*fragments, "".join(now)], "leaves": leaves, "numbers": numbers}


LEAVES = pa.list_(pa.struct([("rule", pa.string()), ("text", pa.string())]))


def masked(rule: Column, text: Column) -> Column:
    """A string without literals, or REDACTED where that cannot be made sure."""
    with_mask = lambda t: F.transform(F.array(query_text.canonical(t)), lambda c: F.when(query_text.mask_ok(c), c).otherwise(REDACTED))[0]
    label = F.regexp_replace(text, IN_LABEL, "$1\0")  # names keep their text, the rest leaves the mark alone
    label = F.replace(F.regexp_replace(label, rf"(?<=[\p{{L}}\p{{N}}_$@`])\x00", ""), F.lit("\0"), F.lit("?"))
    odd = label.rlike(OPEN_LABEL) | label.rlike(ODD_NAME) | (F.length(F.regexp_replace(label, "[^`]", "")) % 2 == 1)
    return F.when(rule == "label", F.when(odd, REDACTED).otherwise(label)).when((rule == "expression") | text.rlike(LITERAL), with_mask(text)).otherwise(text)


def mask_plans(plans: DataFrame, keep: tuple[str, ...] = ("plan_id",)) -> DataFrame:
    """The columns ``keep`` with masked_json and redactions, the strings and numbers that were given up whole.

    Keys, their order and numbers of estimate keys stay as written; other numbers are "?". Strings of safe keys stay, those of
    expressions and others that may hold a literal are canonical text, labels keep all but their literals. What is no document
    (see ``flatten.document``) gives no row.
    """
    kept = plans.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_cut(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            rows = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            found = [x for x in found if x]
            own = [pa.array([x["fragments"] for x in found], pa.list_(pa.string())), pa.array([x["leaves"] for x in found], LEAVES), pa.array([x["numbers"] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-1]), *own], names=[*batch.schema.names[:-1], "__fragments", "__leaves", "__numbers"])

    cut = plans.select(*keep, "plan_json").mapInArrow(
        run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), "__fragments array<string>, __leaves array<struct<rule string, text string>>, __numbers bigint"])
    )
    done = cut.withColumn("__masked", F.transform("__leaves", lambda x: masked(x["rule"], x["text"])))
    quoted = lambda t: F.regexp_replace(F.to_json(F.array(t)), r"(?s)^\[|\]$", "")
    joined = F.array_join(F.zip_with("__fragments", F.concat(F.transform("__masked", quoted), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    lost = F.size(F.filter("__masked", lambda x: x == REDACTED))
    return done.select(*keep, joined.alias("masked_json"), (F.col("__numbers") + lost).alias("redactions"))
