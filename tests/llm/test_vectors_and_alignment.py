"""Near-duplicate vectors, hard negatives and token alignment against plain versions, whole rows."""

import collections
import hashlib
import json
import math

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("querywatch.llm")
import pandas as pd  # noqa: E402
import pyarrow.parquet as pq  # noqa: E402
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from querywatch.llm import cross_tokens, hard_negatives, near_vectors, queries  # noqa: E402

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<float>, label int, dim int, n_links string, score double"


def vectors(seed=4, n=260, dim=12):
    """Random directions, families around some of them, exact copies, rows that cannot link, ties and repeated ids."""
    r = np.random.default_rng(seed)
    rows, centres = [], r.normal(size=(6, dim))
    for i in range(n):
        if i % 2:
            x = centres[i % 6] + r.normal(size=dim) * (0.02 if i % 3 else 0.13)
        else:
            x = r.normal(size=dim)
        rows.append((i, [float(v) for v in x.astype("float32")], int(r.integers(0, 4))))
    tight = centres[0] + r.normal(size=(60, dim)) * 0.002
    rows += [(1000 + i, [float(v) for v in x.astype("float32")], 1) for i, x in enumerate(tight)]
    rows += [(2000 + i, rows[9][1], 1 if i < 20 else 2) for i in range(30)]
    odd = [None, [], [0.0] * dim, [-0.0] * dim, [1.0, None] + [0.0] * (dim - 2), [NAN] + [1.0] * (dim - 1), [INF] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0], [1e-30] * dim, [1e30] * dim]
    rows += [(3000 + i, x, 1) for i, x in enumerate(odd)] + [(3100, rows[3][1], None), (3200, rows[1][1], 1), (3200, rows[1][1], 1), (None, rows[1][1], 1), (None, [7.0] * dim, 3), (3300, [-0.0, 1.0], 2), (3301, [0.0, 1.0], 2)]
    return [(*row, 5, "x", 0.5) for row in rows]


def valid(x):
    return x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x) and any(x)


def plain_classes(rows, least=0.98):
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    units = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if valid(r[1]) else None for r in rows]
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] @ units[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low.setdefault(find(i), []).append(rows[i][0])
    first = [min((x for x in low[find(i)] if x is not None), default=None) for i in range(n)]
    return sorted([(rows[i][0], links[i], first[i], first[i] is None or rows[i][0] == first[i]) for i in range(n)], key=repr)


def as_rows(df):
    return sorted([(*r,) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()], key=repr)


@pytest.mark.parametrize(("cell", "tile"), [(2048, 4096), (30, 25), (12, 6)])
def test_near_vectors_match_brute_force(spark, monkeypatch, cell, tile):
    for name, value in (("CELL", cell), ("TILE", tile)):
        monkeypatch.setattr(near_vectors, name, value)
    rows = vectors()
    assert as_rows(near_vectors.classes(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain_classes(rows)


def test_near_vectors_of_doubles_by_another_label(spark):
    rows = vectors(7, 60)
    df = spark.createDataFrame(rows, SCHEMA).select("vec_id", F.col("label").cast("string").alias("kind"), F.col("embedding").cast("array<double>").alias("v"))
    assert as_rows(near_vectors.classes(df, "v", "kind", cosine=0.9)) == plain_classes(rows, 0.9)
    with pytest.raises(TypeError):
        near_vectors.classes(df.withColumn("vec_id", F.lit("a")), "v", "kind")
    assert near_vectors.classes(df.limit(0), "v", "kind").count() == 0


def test_near_vectors_meet_once_and_cores_are_not_compared():
    r = np.random.default_rng(0)
    x = near_vectors.units(np.concatenate([r.normal(size=(200, 6)), r.normal(size=6) + r.normal(size=(200, 6)) * 0.01]))
    pivots, limit = near_vectors.spread(x[::17], 0.2), math.sqrt(0.04)
    row, cell, kind = near_vectors.places(x, pivots, limit)
    held = collections.defaultdict(dict)
    for i, c, k in zip(row.tolist(), cell.tolist(), kind.tolist(), strict=True):
        held[c][i] = k
    assert sorted(row[(kind == near_vectors.CORE) | (kind == near_vectors.OWN)].tolist()) == list(range(len(x)))  # one home each
    met = collections.Counter()
    for of in held.values():
        for i, a in of.items():
            for j, b in of.items():
                if i < j and not (a >= near_vectors.CORE_COPY and b >= near_vectors.CORE_COPY):
                    met[i, j] += 1
                    if a in (near_vectors.CORE, near_vectors.CORE_COPY) and b in (near_vectors.CORE, near_vectors.CORE_COPY):
                        assert x[i] @ x[j] >= 0.98
    close = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.98)) if i < j}
    assert close <= set(met) and set(met.values()) == {1} and len(pivots) > 5


def test_stripes_of_a_tile_give_the_same(monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(size=(90, 4))
    kind, block, m = r.integers(0, 2, 90), r.integers(0, 2, 90), r.integers(1, 5, 90)
    want = near_vectors.compare(x, kind, block, m, 0.9)
    monkeypatch.setattr(near_vectors, "STRIPE", 7)
    got = near_vectors.compare(x, kind, block, m, 0.9)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and want[0].sum() > 50


def test_borderline_cosines_are_summed_exactly():
    a = np.array([[1.0, 0.0], [0.98, math.sqrt(1 - 0.98**2)]])
    one = np.ones(2, np.int64)
    for least, n in ((near_vectors.cosine_of(*near_vectors.scaled(a)), 1), (np.nextafter(near_vectors.cosine_of(*near_vectors.scaled(a)), 1), 0)):
        links, _ = near_vectors.compare(a, one, np.zeros(2, int), one, least)
        assert links.tolist() == [n, n]


# --- hard negatives -----------------------------------------------------------------------------------------


def plain_negatives(rows, is_anchor, scale=256.0, choice=hard_negatives.Choice()):
    take = [(i, r[0], r[2], [math.floor(scale * v) for v in r[1]]) for i, r in enumerate(rows) if r[0] is not None and r[2] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    out = []
    for i, vec_id, label, x in take:
        if not is_anchor(vec_id):
            continue
        met = [(max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), j, k, of) for k, j, of, y in take if k != i and len(y) == len(x)]
        near = sorted((m for m in met if m[3] == label), key=lambda m: (-m[0], m[1], m[2]))[: choice.positives]
        for p, positive, *_ in near:
            fit = sorted((m for m in met if m[3] != label and choice.low * p <= 100 * m[0] <= choice.high * p), key=lambda m: (-m[0], m[1], m[2]))[: choice.negatives]
            out += [(vec_id, positive, n + 1, m[1], p, m[0]) for n, m in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("rows_of", "anchors_of"), [(1 << 16, 1 << 13), (40, 7)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, rows_of, anchors_of):
    for name, value in (("ROWS", rows_of), ("ANCHORS", anchors_of)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = [r for r in vectors() if not (r[1] and any(v and abs(v) > 1e20 for v in r[1]))]
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0, scale=256.0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert sorted([(*r,) for r in got.collect()]) == want and len(want) > 500


def test_hard_negatives_with_wide_integers_and_without_anchors(spark):
    rows = vectors(9, 40)  # 1e30 among them: scores beyond 64 bits stay at the largest number
    df = spark.createDataFrame(rows, SCHEMA)
    choice = hard_negatives.Choice(3, 4, -50, 80)
    got = hard_negatives.mine(df, F.col("vec_id") % 3 == 0, scale=2.0**20, choice=choice)
    assert sorted([(*r,) for r in got.collect()]) == plain_negatives(rows, lambda i: i % 3 == 0, 2.0**20, choice)
    assert hard_negatives.mine(df, F.lit(False)).count() == 0 and hard_negatives.mine(df.limit(0), F.lit(True)).count() == 0
    with pytest.raises(TypeError):
        hard_negatives.mine(df.withColumn("vec_id", F.lit("a")), F.lit(True))


@pytest.mark.parametrize("same", [True, False])
def test_best_in_small_stripes(monkeypatch, same):
    r = np.random.default_rng(5)
    centre = r.normal(size=(5, 20)) * 200
    make = lambda n, at: hard_negatives.Side(np.arange(n) + at, r.integers(0, 60, n), r.integers(0, 2, n), x := np.floor(centre[r.integers(0, 5, n)] + r.normal(size=(n, 20)) * 20), hard_negatives.summaries(x))
    rows, anchors = make(300, 0), make(23, 290)
    exact = hard_negatives.scores(anchors.x, rows.x)
    low, high = np.sort(r.choice(exact.ravel(), (2, 23, 3)), axis=0)
    want = []
    for a in range(23):
        for j in range(3):
            fit = [(-exact[a, c], rows.vec_id[c], rows.row[c]) for c in range(300) if (anchors.label[a] == rows.label[c]) == same and anchors.row[a] != rows.row[c] and low[a, j] <= exact[a, c] <= high[a, j]]
            want += [(3 * a + j, c, -s) for s, _, c in sorted(fit)[:4]]
    for stripe, chunk in ((64, 4096), (4, 19)):
        monkeypatch.setattr(hard_negatives, "STRIPE", stripe)
        monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
        q, c, s = hard_negatives.best(anchors, rows, same, low, high, 4)
        assert sorted(zip(q.tolist(), rows.row[c].tolist(), s.tolist())) == sorted(want) and len(want) > 50


def test_summaries_bound_scores():
    r = np.random.default_rng(1)
    for dim in (1, 3, 12, 64):
        a, b = np.floor(r.normal(size=(30, dim)) * 300), np.floor(r.normal(size=(40, dim)) * 300 + r.normal(size=(40, 1)) * 500)
        exact = hard_negatives.scores(a, b)
        assert (exact == (a @ b.T).astype(np.int64)).all()
        widths = []
        for level in range(len(hard_negatives.LEVELS)):
            least, most = hard_negatives.bounds(hard_negatives.summaries(a), hard_negatives.summaries(b), dim, level)
            assert (least <= exact).all() and (exact <= most).all()
            widths.append((most - least).mean())
        assert widths == sorted(widths, reverse=True)


def test_op11_and_op13_equal_their_sql(spark, tmp_path):
    import duckdb

    rows = [r for r in vectors(5) if r[0] is not None and r[1] is not None and len(r[1]) == 12 and not (r[1] and any(v and abs(v) > 1e20 for v in r[1]))]
    rows = list({r[0]: r for r in rows}.values())
    frame = pd.DataFrame({"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows], "label": pd.array([r[2] for r in rows], "Int32")})
    pq.write_table(pa.Table.from_pandas(frame, schema=pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for name in ("op11_hard_negatives", "op13_near_vectors"):
        got = queries.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
        assert sorted((*r,) for r in got.collect()) == sorted(want) and want


# --- alignment ----------------------------------------------------------------------------------------------

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "one two  three", "tab\there", "line\nbreaks\r\n", "it's we'll 'S don't", "é漢字\U0001f600 ümlaut ß", "▁odd mark", "nul\0l", "<s> </s> <unk> <0x41> <|endoftext|>", "x" * 400, "antidisestablishmentarianism " * 30, " lead", "trail ", "ﬁ ligature ½ ①", "é combining", "1234567890 12,5 %", " nbsp 　wide"]


def plain_alignment(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) from the libraries, token by token."""
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    letters = cross_tokens.byte_alphabet()
    docs, total = [], collections.Counter()
    for doc_id, text in rows:
        want = (" " + (text or "")).encode()
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        raw_a = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        raw_b = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            docs.append((doc_id, [], [], [], ""))
            continue
        spans = [[], []]
        for raw, of in ((raw_a, spans[0]), (raw_b, spans[1])):
            at = 0
            for t in raw:
                of.append((at, at + len(t)))
                at += len(t)
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in shared:
            groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, of) if start < e <= end) for ids, of in ((a, spans[0]), (b, spans[1]))))
            start = end
        pairs = [(a[i], b[j]) for i, j in links]
        total.update(pairs)
        docs.append((doc_id, a, b, pairs, ";".join(groups)))
    best = collections.Counter()
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    return sorted(((i, len(a), len(b), len(g.split(";")) if g else 0, len(p), sum(total[x] == best[x[1]] for x in p), sum(total[x] for x in p), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, p, g in docs), key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("few", [1 << 19, 0])
def test_alignment_matches_the_libraries(spark, monkeypatch, few):
    monkeypatch.setattr(cross_tokens, "FEW", few)
    r = np.random.default_rng(2)
    words = "the of and low er new est token isation über naïve 12 3.5 end. (x) ".split(" ")
    texts = TEXTS + [" ".join(r.choice(words, 50)) for _ in range(12)] + ["".join(r.choice(list("ab é漢\t\n '.1"), 40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, "null id"), (77, " ".join(r.choice(words, 3000)))]
    df = spark.createDataFrame([(*row, 1, "x", 2) for row in rows], "doc_id bigint, text string, n_a int, links string, row int").coalesce(2)
    got = cross_tokens.align(df, A, B, keep=("doc_id", "links", "row", "n_a"))
    assert got.columns == ["doc_id", "links", "row", *(c for c in COLUMNS[1:])]
    want = plain_alignment(rows)
    assert sorted([(*x,) for x in got.select(COLUMNS).collect()], key=repr) == want
    assert {x[1] > 0 for x in want} == {True, False}
    assert cross_tokens.align(df.limit(0), A, B).count() == 0


def test_small_groups_memos_and_sums_give_the_same_links(monkeypatch):
    texts = [t or "" for t in TEXTS] * 3

    def told():
        batches = list(cross_tokens._aligned(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]), A, B))
        rows = [x for b in batches for x in b.to_pylist()]
        add = lambda lists: {p: n for p in {x >> cross_tokens.TIMES for y in lists for x in y} if (n := sum(x & ((1 << cross_tokens.TIMES) - 1) for y in lists for x in y if x >> cross_tokens.TIMES == p))}
        docs = [x for x in rows if x["sums"] is None]
        assert add([x["links"] for x in docs]) == add([x["sums"] for x in rows if x["sums"] is not None]) and sum(x["n_links"] for x in docs) == sum(add([x["links"] for x in docs]).values())
        return [(x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["groups_sha256"], add([x["links"]])) for x in docs], len(rows) - len(docs)

    want, one = told()
    for where, name, value in ((cross_tokens.byte_bpe, "GROUP", 40), (cross_tokens, "MEMO", 5), (cross_tokens, "SUMS", 3), (cross_tokens, "TIMES", 2)):
        monkeypatch.setattr(where, name, value)
    got, several = told()
    assert got == want and one == 1 and several > 5


def test_op12_equals_the_libraries(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet", index=False)
    got = queries.queries()["op12_cross_tokens"](spark, str(tmp_path))
    assert sorted([(*x,) for x in got.select(COLUMNS).collect()], key=repr) == plain_alignment(rows)


def test_encoder_agrees_with_the_library_on_every_code_point():
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" a1" + "".join(f"{c}b {c}" for c in chars[i : i + 64]) for i in range(0, len(chars), 64 * 37)]  # every 37th run of 64
    got = cross_tokens.byte_bpe.encode_texts(pa.array(texts), cross_tokens.byte_level(A))
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert got.ids.tolist() == [i for x in want for i in x]


def test_merges_out_of_order_are_refused(tmp_path):
    spec = json.load(open(A, encoding="utf-8"))
    merges = spec["model"]["merges"]
    merges[5], merges[900] = merges[900], merges[5]
    (tmp_path / "odd.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="order"):
        cross_tokens.byte_level(str(tmp_path / "odd.json"))
