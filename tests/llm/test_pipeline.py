"""Every registered query and every pipeline stage on a small written table, whole rows against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("querywatch.llm")
import duckdb  # noqa: E402
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from querywatch.llm import byte_bpe, mixing, queries, toxicity  # noqa: E402

LANGS = {"en": "the cat and house with this thing of an old river", "de": "der Hund und das Haus mit für schön ß über", "fr": "le chat et la maison avec cette où été français"}
SECRET = "Zq3xV9mLw2RtY7uKp0sD4fGh8jBn6cXe"


def sources():
    r = np.random.default_rng(8)
    rows = []
    for i in range(90):
        lang = list(LANGS)[i % 3]
        words = list(r.choice(LANGS[lang].split(), 40 + i % 7)) + [f"w{r.integers(10**6)}" for _ in range(12)]
        if i % 5 == 0:
            words[3:3] = ["idiot", "moron", "scum"]
        rows.append((3 * i, " ".join(words), lang if i % 11 else None, f"s{i % 4}" if i % 13 else None))
    long = " ".join(f"x{i}" for i in range(3000))
    rows += [(301, None, None, None), (302, "", "en", "s1"), (303, " \t", "en", "s1"), (304, "123 !", "de", "s1"), (305, long, "en", "s2"), (306, long + " tail", "en", "s2"), (307, rows[4][1].replace(" ", "\n"), "en", "s1"), (308, rows[4][1] + " more", "en", "s0")]
    rows += [(309, f'token = "abcdefgh12" AKIA{"A1B2" * 4} {"0a1b" * 8} é {SECRET}', "en", "s1"), (310, "password: short secret=\ttoolong123 漢\U0001f600 <|endoftext|>", "en", "s1"), rows[7], (rows[9][0], "another text under a used id", "en", "s3")]
    return rows


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = sources()
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
    docs["n_chars"] = [len(t or "") for t in docs.text]
    docs.to_parquet(at / "documents.parquet", index=False)
    toxic = [int("idiot" in (t or "")) for t in docs.text]
    pd.DataFrame({"doc_id": docs.doc_id, "quality": 1, "toxic": toxic}).to_parquet(at / "labels.parquet", index=False)
    return str(at), rows


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def got(spark, tables, name):
    rows = queries.queries()[name](spark, tables[0]).collect()
    assert len(rows) == len(tables[1])
    return rows


def by_id(rows):
    return sorted(rows, key=lambda r: r["doc_id"])


def test_op1_base_spans(spark, tables):
    assign = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    kinds = {"assign": (assign, lambda m: len(m[2]) >= 6), "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)}
    want = []
    for i, t, *_ in tables[1]:
        found = [(m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(kinds.items()) for m in p.finditer(t or "") if ok(m)]
        base = [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]
        want.append((i, *(sum(x[2] == k for x in found) for k in kinds), hashlib.sha256(",".join(base).encode()).hexdigest(), base))
    rows = got(spark, tables, "op1_secret_scan")
    assert sorted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == sorted(w[:5] for w in want)
    spans = {r["doc_id"]: r["spans"].split(",") for r in rows}
    assert all(set(w[5]) <= set(spans[w[0]]) for w in want)
    text = next(t for i, t, *_ in tables[1] if i == 309)
    assert f"random:{text.index(SECRET)}:{text.index(SECRET) + len(SECRET)}" in spans[309]
    assert not any(s.startswith("random") for i, found in spans.items() if i != 309 for s in found)


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op2_edited_and_next(spark, tables):
    plain = [r for r in tables[1] if r[0] not in (21, 27)]  # ids that are there once
    rows = {r["doc_id"]: r for r in queries.op2_document_fingerprints(spark, tables[0]).collect()}
    order = sorted(tables[1], key=lambda r: -r[0])
    after = {r[0]: order[(k + 1) % len(order)] for k, r in enumerate(order)}
    for i, t, *_ in plain:
        if after[i][0] in (21, 27):
            continue
        t, nxt, r = t or "", after[i][1] or "", rows[i]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(alike(t, edited), abs=0.15 if len(shingles(t)) > 100 else 1e-9)
        assert r["near_next"] == pytest.approx(alike(t, nxt), abs=0.15 if len(shingles(t)) > 100 else 1e-9)
    same = [rows[i]["fingerprint"] for i in (301, 302)]
    assert same[0] == same[1]


def test_op3_learns_from_rows_that_are_not_held_out(spark, tables, tmp_path):
    rows = by_id(got(spark, tables, "op3_language_id"))
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (301, 302, 303, 304))
    other = pd.DataFrame(tables[1], columns=["doc_id", "text", "lang", "source"])
    other.loc[other.doc_id.map(held), "lang"] = "xx"
    other["source"] = "elsewhere"
    other.to_parquet(tmp_path / "documents.parquet", index=False)
    again = by_id(queries.op3_language_id(spark, str(tmp_path)).collect())
    assert [(r["doc_id"], r["lang_pred"], r["score"]) for r in again] == [(r["doc_id"], r["lang_pred"], r["score"]) for r in rows]
    known = {i: lang for i, _, lang, _ in tables[1] if lang and i < 301}
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in rows if r["doc_id"] in known]) > 0.9


def test_op4_scores_every_row(spark, tables):
    rows = got(spark, tables, "op4_quality")
    assert all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def taken(spark, rows, target):
    """Plain version of the mixing: budgets by leaf, each epoch in the order of its hash."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    dom = lambda s: None if s is None else f"domain{zlib.crc32(s.encode()) % 4}"
    h = F.pmod(F.xxhash64(F.lit(target.seed), F.col("e").cast("bigint"), F.col("i").cast("bigint")), F.lit(mixing.SPACE))
    order = {(r["e"], r["i"]): r["h"] for r in spark.createDataFrame([(e, r[0]) for e in range(target.epochs + 1) for r in rows], "e bigint, i bigint").select("e", "i", h.alias("h")).collect()}
    leaves = {}
    for i, t, lang, source in rows:
        leaves.setdefault((dom(source), lang, source), []).append((i, words(t)))
    plan, out = mixing.budgets({k: sum(n for _, n in v) for k, v in leaves.items()}, target), []
    for leaf, docs in leaves.items():
        total, left, e = sum(n for _, n in docs), plan[leaf], 0
        while left > 0 or (total == 0 and e == 0):
            start = 0
            for i, n in sorted(docs, key=lambda d: (order[e, d[0]], d[0], d[1])):
                if (use := min(n, left)) > 0 or n == 0 and e == 0:
                    out.append((i, e, start, n, use))
                left, start = left - use, start + n
            e += 1
    return sorted(out)


def test_op5_takes_seeded_prefixes(spark, tables):
    rows = queries.op5_mixing(spark, tables[0]).collect()
    want = taken(spark, tables[1], mixing.Target(share=1.0, weight=lambda path, n: 1.0, epochs=2))
    once = lambda rows: [r for r in rows if r[0] not in (21, 27)]  # noqa: E731  rows of one id follow each other in any order
    assert once(sorted((r["doc_id"], r["epoch"], r["start"], r["n_tokens"], r["taken"]) for r in rows)) == once(want)


def test_op6_learns_from_rows_that_are_not_held_out(spark, tables, tmp_path):
    rows = by_id(got(spark, tables, "op6_toxicity"))
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    text = {i: t or "" for i, t, *_ in tables[1]}
    assert all(r["predicted"] == ("idiot" in text[r["doc_id"]]) for r in rows if r["doc_id"] < 301 and r["doc_id"] != 27)
    pd.DataFrame(tables[1], columns=["doc_id", "text", "lang", "source"]).assign(lang="q", source=None).astype({"source": "string"}).to_parquet(tmp_path / "documents.parquet", index=False)
    labels = pd.read_parquet(f"{tables[0]}/labels.parquet")
    labels.loc[labels.doc_id.map(held), "toxic"] = 1
    labels.to_parquet(tmp_path / "labels.parquet", index=False)
    again = by_id(queries.op6_toxicity(spark, str(tmp_path)).collect())
    assert [(r["doc_id"], r["score"]) for r in again] == [(r["doc_id"], r["score"]) for r in rows]


def test_op7_equals_its_sql(spark, tables):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tables[0]}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op7_exact_dedup"]).fetchall()
    columns = ("doc_id", "keep_id", "group_size", "text_sha256")  # of repeated rows one is kept
    assert sorted(tuple(r[c] for c in columns) for r in got(spark, tables, "op7_exact_dedup")) == sorted((r[0], r[1], r[2], r[4]) for r in want)


def components(texts):
    label = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return sets, label


def test_op8_links_and_components(spark, tables):
    ids, texts = [r[0] for r in tables[1]], [r[1] for r in tables[1]]
    sets, label = components(texts)
    least = {c: min(i for i, x in zip(ids, label) if x == c) for c in label}
    want = sorted((i, len(s), least[c]) for i, s, c in zip(ids, sets, label))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got(spark, tables, "op8_jaccard_join")) == want


def test_op9_equals_the_library(spark, tables):
    own, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, t, *_ in sorted(tables[1], key=lambda r: r[0]):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    once = lambda rows: [r for r in sorted(rows) if r[0] not in (21, 27)]  # noqa: E731  rows of one id follow each other in any order
    assert once((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got(spark, tables, "op9_token_store")) == once(want)


def encoded(i, t):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    ids = own.encode_ordinary(t or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())


def test_op10_equals_the_library(spark, tables):
    rows = got(spark, tables, "op10_byte_bpe")
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(encoded(*r[:2]) for r in tables[1])


# --- the pipeline -------------------------------------------------------------------------------------------

CLASHES = "score string, ids string, decoded string, h int, __of string, label int, row_id string, keep_id int"
COLUMNS = "doc_id bigint, text string, lang string, source string, " + CLASHES


def stored(spark, rows, path):
    data = [(*r, "mine", "i", "d", 5, "o", 6, "r", 7) for r in rows]
    spark.createDataFrame(data, COLUMNS).write.parquet(str(path))
    return spark.read.parquet(str(path))


def kept(df):
    assert df.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    rows = df.collect()
    assert all(tuple(r)[4:] == ("mine", "i", "d", 5, "o", 6, "r", 7) for r in rows)
    return sorted((tuple(r)[:4] for r in rows), key=repr)


def test_stages(spark, tables, tmp_path):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "exact dedup", "near dedup", "mixing", "byte-level BPE"]
    rows = [*tables[1], (None, "a null id", "en", "s1"), (None, tables[1][2][1], "en", "s1")]
    docs = stored(spark, rows, tmp_path / "0")
    trained = toxicity.train(docs, spark.read.parquet(f"{tables[0]}/labels.parquet").filter(~queries.held_out()))
    low = toxicity.score(docs, trained, keep=("doc_id", "text", "lang", "source"), into="s").filter(F.col("s") < toxicity.CUT).drop("s").collect()
    after = kept(stage["toxicity"](spark, docs, tables[0]))
    assert after == sorted(map(tuple, low), key=repr) and not any("idiot" in (r[1] or "") for r in after) and len(after) > 60

    docs, groups = stored(spark, after, tmp_path / "1"), {}
    for r in after:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r)
    exact = kept(stage["exact dedup"](spark, docs, tables[0]))
    assert len(exact) == len(groups) and {r[0] for r in exact if r[0] is not None} >= {min(r[0] for r in g) for g in groups.values() if None not in [r[0] for r in g]}

    docs = stored(spark, exact, tmp_path / "2")
    _, label = components([r[1] for r in exact])
    order = lambda r: (r[0] is None, r[0] or 0)
    near = kept(stage["near dedup"](spark, docs, tables[0]))
    first = [min((r for r, x in zip(exact, label) if x == c), key=order) for c in set(label)]
    assert near == sorted(first, key=repr) and len(near) < len(exact)

    near = [r for r in near if r[0] is not None]
    docs = stored(spark, near, tmp_path / "3")
    mixed = kept(stage["mixing"](spark, docs, tables[0]))
    want = {x[0] for x in taken(spark, near, mixing.Target(share=0.9, epochs=1))}
    assert {r[0] for r in mixed} | {27} == want | {27}

    docs = stored(spark, mixed, tmp_path / "4")
    last = stage["byte-level BPE"](spark, docs, tables[0]).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in last) == sorted(encoded(*r[:2]) for r in mixed)


def test_stages_on_an_empty_table(spark, tables, tmp_path):
    docs = stored(spark, [], tmp_path / "0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables[0]).count() == 0


def test_run_is_its_stages(spark, tables):
    rows = corpus_pipeline.run(spark, tables[0]).collect()
    ids = {r[0] for r in tables[1]}
    assert 30 < len(rows) < len(tables[1]) and all(r["doc_id"] in ids and r["n_tokens"] >= 0 for r in rows)
