"""Query text of any nesting, plan documents that are odd or deep, and plans without literals."""

import json

import pytest
from pyspark.sql import functions as F

from querywatch.functions import query_text as qt
from querywatch.plans import flatten, mask


def shown(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("c", qt.canonical(F.col("t")))
    rows = df.select("i", "c", qt.statement_type(F.col("c")).alias("k"), qt.table_refs(F.col("c")).alias("r"), qt.mask_ok(F.col("c")).alias("ok")).orderBy("i").collect()
    return [(r["c"], r["k"], [tuple(x) for x in r["r"]], r["ok"]) for r in rows]


def test_types_and_tables_at_any_depth(spark):
    deep = "(" * 60 + "select 1" + ")" * 60
    cases = [
        (f"with x as ({deep}) update t set a = 1", "update", [(None, "t", None)]),
        ("(with a as (select 1) select * from a)", "select", [(None, "a", None)]),
        (f"select * from ({deep}) d, t1 as a, `S`.t2 b, {deep}", "select", [(None, "t1", "a"), ("s", "t2", "b")]),
        ("select * from t use index for join (i, (j)) force index (k) as x left join u partition (p0) v on 1 straight_join w", "select", [(None, "t", "x"), (None, "u", "v"), (None, "w", None)]),
        ("select 1 from a where b in (select c from d where e in (select f from (select 1 from g) h, i))", "select", [(None, "a", None), (None, "d", None), (None, "i", None)]),
        ("update low_priority t set a = 1", "update", []),
        ("select a from t1 join t2 using (x), t3", "select", [(None, "t1", None), (None, "t2", None)]),
        ("delete from a.b where c = 1", "delete", [("a", "b", None)]),
        ("select 1 from t ignore index (i", "select", [(None, "t", None)]),
        ("select 1 from", "select", []), ("with x as (select 1", "other", []), (") ( select", "other", []), ("truncate table x", "ddl", []), ("explain select 1 from t", "other", [(None, "t", None)]),
        (None, "other", []), ("", "other", []), ("/*+ hint */ ((replace into r values (1)))", "replace", []),
    ]
    assert [(k, r) for _, k, r, _ in shown(spark, [c[0] for c in cases])] == [c[1:] for c in cases]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select now() + interval '1:1' minute_second", "SELECT now ( ) + INTERVAL ? MINUTE_SECOND"),
        ("select cast(a as varcharacter(5)), b long, c mediumtext", "SELECT cast ( a AS VARCHARACTER ( ... ) ) , b LONG , c MEDIUMTEXT"),
        ("select regexp, `regexp`, substr(a, 1), mid(b, 2)", "SELECT RLIKE , regexp , substring ( a , ? ) , substring ( b , ? )"),
        ("select current_date, date(x) from t where y > z - interval 2 sql_tsi_month", "SELECT curdate , date ( x ) FROM t WHERE y > z - INTERVAL ? month"),
        ("signal sqlstate '45000'", "SIGNAL SQLSTATE ?"),
        ("select group_concat(distinct status order by status asc separator ',')", "SELECT group_concat ( DISTINCT status ORDER BY status ASC SEPARATOR ? )"),
    ],
)
def test_reserved_words(spark, text, want):
    assert shown(spark, [text])[0][0] == want


def test_case_quoting_and_spacing_share_a_digest(spark):
    same = [["SELECT * FROM orders WHERE id = 1", "select * from orders where id = 1", "SELECT   *   FROM   orders   WHERE   id  =  1", "/* leading */ SELECT * FROM `orders` WHERE id = 0x1F -- end"],
            ["SELECT id FROM shop.orders WHERE id = 1", "SELECT id FROM `shop`.`orders` WHERE id = .5e3"], ["SELECT 1 WHERE a IN (1)", "SELECT 2 WHERE a IN (1, 2,3)"]]
    for texts in same:
        assert len({c for c, *_ in shown(spark, texts)}) == 1


def test_open_quotes_of_any_kind_fail_the_mask(spark):
    assert [x[3] for x in shown(spark, ["select 'a", 'select "a', "select `a", "select 'a' /*+ it's */"])] == [False, False, False, True]


# --- plans --------------------------------------------------------------------------------------------------

DEEP = '{"query_block":' + '{"a":' * 5000 + '{"table_name":"t"}' + "}" * 5001
LISTS = '{"query_block":{"a":' + "[" * 3000 + "]" * 3000 + "}}"
ODD = {
    "deep": DEEP, "wide": LISTS, "huge": '{"query_block":{"table":{"table_name":"t","rows_examined_per_scan":1e30,"rows_produced_per_join":"1e400","filtered":"nan","cost_info":{"prefix_cost":1' + "0" * 400 + "}}}}",
    "half": '{"query_block":{"table":{"table_name":"\\ud800x","key":"\\u00e9"}}}', "edge": '{"query_block":' + '{"a":' * 63 + '{"table_name":"in","b":{"table_name":"out"}}' + "}" * 64,
    "list": "[1]", "text": '"a"', "broken": '{"query_block":', "void": None, "empty": "", "good": '{"query_block":{"table":{"table_name":"ok"}}}',
}


def test_odd_documents_end_no_job(spark):
    plans = spark.createDataFrame(list(ODD.items()), "plan_id string, plan_json string")
    got = {r["plan_id"]: r for r in flatten.parse_plans(plans).collect()}
    assert set(got) == {"huge", "half", "edge", "good"}
    (node,) = got["huge"]["nodes"]
    assert (node["rows_examined"], node["rows_produced"], node["filtered"], node["cost"]) == (2**63 - 1, None, None, None)
    assert [(n["table_name"], n["key"]) for n in got["half"]["nodes"]] == [("?x", "é")]
    assert [n["table_name"] for n in got["edge"]["nodes"]] == ["in"]  # the walk ends at depth 64
    assert {r["plan_id"] for r in mask.mask_plans(plans).collect()} == set(got)
    for read in (flatten.plan_warnings, flatten.plan_summary, flatten.plan_nodes):
        assert read(flatten.parse_plans(plans)).count() > 0


def masked(spark, doc):
    row = mask.mask_plans(spark.createDataFrame([(1, doc)], "plan_id int, plan_json string")).first()
    return row["masked_json"], row["redactions"]


@pytest.mark.parametrize(
    ("doc", "want", "redactions"),
    [
        ('{"table_name": "t 5", "key": "k\'1"}', '{"table_name":"t 5","key":"k\'1"}', 0),  # safe keys stay
        ('{"attached_condition": "(`a`.`b` = \'se\\"cret\') and c in (1,2)"}', '{"attached_condition":"( a . b = ? ) AND c IN ( ... )"}', 0),
        ('{"note": "plain words", "other": "a 5", "more": "a5 b_6"}', '{"note":"plain words","other":"a ?","more":"a5 b_6"}', 0),
        ('{"ranges": ["(\'a\' <= x <= \'b\')", "it\'s"]}', '{"ranges":["( ? <= x <= ? )","<redacted>"]}', 1),  # items have their array's key
        ('{"select_id": 7, "read_cost": 1.50, "filtered": 1e2, "limit": 5, "list": [1, 2.5]}', '{"select_id":7,"read_cost":1.50,"filtered":1e2,"limit":"?","list":["?","?"]}', 3),
        ('{"a": true, "b": null, "c": {}, "d": [], "\\u00fc\\"": "\\n"}', '{"a":true,"b":null,"c":{},"d":[],"ü\\"":"\\n"}', 0),
        ('{"operation": "Filter: (t.a = \'x\') and b2 > 55  (cost=1.5)"}', '{"operation":"Filter: (t.a = ?) and b2 > ?  (cost=?)"}', 0),  # labels keep case and spaces
        ('{"heading": "Sort `od d`", "operation": "open \'q"}', '{"heading":"<redacted>","operation":"<redacted>"}', 2),
        ('{"operation": "Scan /* 5 */ t", "heading": "Index `k1` on \\"x\\""}', '{"operation":"<redacted>","heading":"Index `k1` on ?"}', 1),
    ],
)
def test_masks_by_hand(spark, doc, want, redactions):
    assert masked(spark, doc) == (want, redactions)


def test_masked_plans_keep_their_tree_and_no_literal(spark):
    doc = {"query_block": {"select_id": 1, "cost_info": {"query_cost": "1.20"}, "nested_loop": [{"table": {"table_name": "t", "attached_condition": "x = 'S3CRET' or y = 991", "used_columns": ["x", "y"]}}, {"message": "saw S3CRET 'S3CRET' 991"}], "limit": 991}}
    text, n = masked(spark, json.dumps(doc))
    tree = lambda v: {k: tree(x) for k, x in v.items()} if isinstance(v, dict) else [tree(x) for x in v] if isinstance(v, list) else 0
    assert tree(json.loads(text)) == tree(doc) and "'S3CRET'" not in text and "991" not in text and n == 1


def test_resolved_names(spark):
    plans = spark.createDataFrame([(1, n) for n in ("oi", "order_items", "x.plain", "twice", "<none>")] + [(2, "t")], "plan_id int, table_name string")
    refs = spark.createDataFrame([(1, 1, "crm", "order_items", "oi"), (1, 2, None, "twice", None), (1, 3, "late", "twice", None), (1, 4, "b", "other", "twice")], "plan_id int, position int, schema_name string, table_name string, alias string")
    got = dict(flatten.resolve_tables(plans, refs, "main").collect())
    assert got == {1: "b.other,crm.order_items,main.<none>,main.order_items,x.plain", 2: "main.t"}  # an aliased table is not known by its name
    assert dict(flatten.resolve_tables(plans, refs.limit(0), None).collect()) == {1: "x.plain", 2: ""}


def test_actual_figures_are_of_all_loops(spark):
    doc = """{"operation": "x", "inputs": [{"table_name": "a", "estimated_rows": 7, "actual_rows": 2.5, "actual_loops": 4, "actual_last_row_ms": 0.5}, {"table_name": "b", "estimated_rows": "3"},
        {"table_name": "c", "rows_examined_per_scan": 9, "actual_last_row_ms": 2}, {"table_name": "d", "actual_rows": 5, "actual_loops": 0}]}"""
    nodes = flatten.plan_nodes(flatten.parse_plans(spark.createDataFrame([(1, doc)], "plan_id int, plan_json string")))
    assert [(r["table_name"], r["shown_rows"], r["time_ms"]) for r in nodes.orderBy("path").collect()] == [("a", 10.0, 2.0), ("b", 3.0, None), ("c", 9.0, 2.0), ("d", 0.0, None)]


def test_lines_below_a_collapsed_node_are_left_out(spark):
    doc = '{"query_block": {"nested_loop": [{"table": {"table_name": "a", "m": {"table": {"table_name": "b", "m": {"table_name": "c"}}}}}, {"table": {"table_name": "d"}}]}}'
    nodes = flatten.plan_nodes(flatten.parse_plans(spark.createDataFrame([(1, doc)], "plan_id int, plan_json string")))
    lines = lambda df: [tuple(r)[1:] for r in flatten.plan_rows(df).orderBy("position").collect()]
    assert lines(nodes) == [(1, "a", 0, True, False), (2, "b", 1, True, False), (3, "c", 2, False, False), (4, "d", 0, False, False)]
    assert lines(nodes.withColumn("collapsed", F.col("table_name") == "a")) == [(1, "a", 0, True, True), (2, "d", 0, False, False)]


def joins(df):
    """Kinds of joins in the plan that is chosen before anything is read."""
    return [x for x in ("BroadcastExchange", "SortMergeJoin", "ShuffledHashJoin") if x in df._jdf.queryExecution().executedPlan().toString()]


def nested_plans(spark):
    doc = {"query_block": {"nested_loop": [{"table": {"table_name": "a", "m": [{"table_name": "b", "m": {"table_name": "c"}}, {"table_name": "d"}]}}, {"x": {"table_name": "e", "m": {"table_name": "f"}}}]}}
    return flatten.plan_nodes(flatten.parse_plans(spark.createDataFrame([(k, json.dumps(doc)) for k in (1, 2)] + [(3, '{"table_name":"r","x":{"table_name":"s"}}')], "plan_id int, plan_json string")))


def test_graph_joins_no_node_with_another(spark):
    df = flatten.plan_graph(nested_plans(spark))
    assert joins(df) == []
    got = {(r.plan_id, r.table_name): (r.parent, r.indent) for r in df.collect()}
    one = {"a": (None, 0), "b": ("a", 1), "c": ("b", 2), "d": ("a", 1), "e": (None, 0), "f": ("e", 1)}
    assert got == {(k, n): v for k in (1, 2) for n, v in one.items()} | {(3, "r"): (None, 0), (3, "s"): ("r", 1)}


def test_lines_join_no_node_with_another(spark):
    nodes = nested_plans(spark)
    df = flatten.plan_rows(nodes.withColumn("collapsed", F.col("table_name").isin("b", "e") | F.when(F.col("table_name") == "d", F.lit(None).cast("boolean"))))
    assert joins(df) == []
    got = [tuple(r)[1:5] for r in df.filter("plan_id = 2").orderBy("position").collect()]
    assert got == [(1, "a", 0, True), (2, "b", 1, True), (3, "d", 1, False), (4, "e", 0, True)]


def test_warnings_pass_each_plan_once(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD.values())], "plan_id int, plan_json string")
    df = flatten.plan_warnings(flatten.parse_plans(docs))
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.table_name or "", r.warning) for r in df.collect()) == [("in", "no_index"), ("ok", "no_index"), ("t", "no_index")]  # "half" has a key
    assert flatten.plan_warnings(flatten.parse_plans(docs.limit(0))).count() == 0
