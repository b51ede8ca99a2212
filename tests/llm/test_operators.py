import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("querywatch.llm")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from querywatch.llm import byte_bpe, exact_dedup, fingerprints, jaccard_join, langid, mixing, quality, secret_scan, token_store, toxicity  # noqa: E402

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potions near old mills".split()
LONG = " ".join(f"{w}{i}" for i in range(700) for w in WORDS)
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "a <|endoftext|> b", "", "one", "a  b", "a\tb", BASE, BASE + " x", BASE, LONG, LONG + " tail", "secret: token: abcdef  token = \"abcdef12\"", "key AKIA" + "A1B2" * 4 + " " + "0a1b" * 8, "'s it's  we'll \n é漢\U0001f600"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_tokens int, ids string, extra int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", 1, "x", 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "null id", "en", "s", 1, "x", 2), rows[6]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    got = exact_dedup.mark(docs).collect()
    groups = {}
    for i, t in [*enumerate(TEXTS), (None, "null id"), (6, TEXTS[6])]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert r["group_size"] == len(groups[text]) and r["keep_id"] == (min(ids) if ids else None)
    assert sum(r["kept"] for r in got) == len(groups) == exact_dedup.deduplicate(docs).count()
    assert exact_dedup.mark(empty).count() == 0 and exact_dedup.deduplicate(docs).columns == docs.columns


def test_small_blocks_name_the_same_groups(docs):
    a, b = (sorted(exact_dedup.mark(docs, block=n).select("doc_id", "keep_id", "group_size").fillna(-1).collect()) for n in (7, 1024))
    assert a == b


def test_byte_bpe_matches_the_library(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    ids = byte_bpe.encode(docs, path, keep=("doc_id", "text"), offsets=True)
    for r in ids.collect():
        assert r["ids"] == own.encode_ordinary(r["text"] or "")
        assert r["slice_starts"] == sorted(set(r["slice_starts"])) and (not r["text"] or r["slice_starts"][0] == 0)
    assert all(r["decoded"] == (r["text"] or "").encode() for r in byte_bpe.decode(ids, path, keep=("text",)).collect())
    assert byte_bpe.encode(empty, path).count() == byte_bpe.round_trip(empty, path).count() == 0
    both = byte_bpe.round_trip(docs, path, keep=("text", "n_tokens", "ids"))  # the kept ids give way to the result
    assert both.columns == ["text", "n_tokens", "ids", "decoded"]
    assert all(r["ids"] == own.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "").encode() for r in both.collect())


@pytest.mark.parametrize("group", [1, 7, 1 << 20])
def test_byte_bpe_on_odd_texts(group, monkeypatch):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    monkeypatch.setattr(byte_bpe, "GROUP", group)
    r = np.random.default_rng(3)
    chars = list("ab ct's're  \n\t.,!12é ß漢字\U0001f600\0'll")
    texts = ["", "a", "\0", "\0\0 a\0", "a" * 700, " " * 300, "é" * 90, "abcdefgh" * 7] + ["".join(r.choice(chars, n)) for n in r.integers(0, 60, 500)]
    cache, got = byte_bpe.merged(path), []
    for part in byte_bpe.groups_of(pa.array(texts)):
        e = byte_bpe.encode_texts(part, cache)
        assert byte_bpe.decode_group(e, cache.vocabulary).to_pylist() == [t.encode() for t in part.to_pylist()]
        got += byte_bpe.as_lists(e.ids_of_text(), e.ids).to_pylist()
    assert got == [own.encode_ordinary(t) for t in texts]


def test_token_store_round_trip(docs, empty, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = token_store.read(spark, token_store.write(plain, path)).orderBy("doc_id").collect()
    start = 0
    for r, t in zip(got, TEXTS, strict=True):
        ids = np.array([*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += r["n_tokens"]
    assert token_store.read(spark, token_store.write(docs, path)).count() == docs.count()
    assert token_store.read(spark, token_store.write(empty, path)).count() == 0


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return [(len(s), x) for s, x in zip(sets, label)]


def test_jaccard_join_matches_brute_force(spark, docs, empty):
    r = np.random.default_rng(5)
    texts = list(TEXTS)
    for size in (2, 4, 6, 8, 12, 20, 40, 90, 200, 400):
        base = [f"z{x}" for x in r.integers(0, 10**6, size)]
        for edits in (0, 1, 1, 2, 3, size // 12, size // 20):
            w = list(base)
            for k in r.integers(0, size, edits):
                w[k] = f"e{r.integers(10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [(x["n_shingles"], x["component_id"]) for x in jaccard_join.classes(df).orderBy("doc_id").collect()]
    assert got == components(texts)
    assert jaccard_join.classes(docs).count() == docs.count() and jaccard_join.classes(empty).count() == 0


def family(n):
    """Texts that share half of their shingles and do not link, short texts of 4 shingles that share one, and some links."""
    r = np.random.default_rng(11)
    fresh = lambda k: [f"u{x}" for x in r.integers(0, 10**9, k)]
    texts = [" ".join([*(f"c{i}" for i in range(84)), *fresh(81)]) for _ in range(n)]
    texts += [" ".join([*(f"k{i}" for i in range(5)), *fresh(3)]) for _ in range(n)]
    return texts + [t + " more" for t in texts[:: n // 4]] + [texts[0] + " more words"]


def test_jaccard_join_keeps_no_pairs_of_a_family_that_cannot_link(spark, tmp_path, monkeypatch):
    whole = jaccard_join._pairs

    def noted(batches, closest):
        for b in whole(batches, closest):
            (tmp_path / f"{uuid.uuid4().hex}-{b.num_rows}").touch()
            yield b

    monkeypatch.setattr(jaccard_join, "_pairs", noted)
    monkeypatch.setattr(jaccard_join, "CROWD", 2)
    texts = family(40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [(x["n_shingles"], x["component_id"]) for x in jaccard_join.classes(df).orderBy("doc_id").collect()]
    assert got == components(texts)
    assert sum(int(f.name.split("-")[1]) for f in tmp_path.iterdir()) <= len(texts)


def test_jaccard_join_in_many_small_tiles(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "CROWD", 2)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)  # more links are left to the pairs
    r = np.random.default_rng(6)
    texts = family(12)
    for size in (5, 7, 9, 30, 120):
        base = [f"z{x}" for x in r.integers(0, 10**6, size)]
        for edits in (0, 1, 1, 2, 3, size // 12, size // 20):
            w = list(base)
            for k in r.integers(0, size, edits):
                w[k] = f"e{r.integers(10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [(x["n_shingles"], x["component_id"]) for x in jaccard_join.classes(df).orderBy("doc_id").collect()]
    assert got == components(texts)


def test_parity_sketch_never_exceeds_the_differences():
    r = np.random.default_rng(7)
    for k in (0, 2, 5, 8, 11, 13):
        n = jaccard_join.edge(k)
        a = r.integers(0, 2**63, 2 * n).astype(np.uint64)
        sets = [np.sort(x) for x in (a[: n + n // 2], a[n // 2 :])]
        for fold in (lambda s, k: s, jaccard_join.folded):
            one, two = (np.frombuffer(fold(jaccard_join.parity_sketch(s, k), k), np.uint64) for s in sets)
            assert np.bitwise_count(one ^ two).sum() <= n // 2 + 2 * n - (n + n // 2)


def test_fingerprints(docs, spark):
    rows = fingerprints.fingerprint(docs).collect()
    assert len({tuple(r["sketch"]) for r in rows if r["doc_id"] in (6, 8)}) == 1
    pair = spark.createDataFrame([(BASE, BASE + " x"), (LONG, LONG), ("", None), (LONG, BASE)], "a string, b string")
    s = pair.select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    got = s.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_count(F.col("a")).alias("n")).collect()
    assert got[0]["r"] == pytest.approx(56 / 57) and got[0]["c"] == 1 and got[0]["n"] == 56
    assert got[1]["r"] == 1 and got[1]["n"] == pytest.approx(len(shingles(LONG)), rel=0.3) and got[2]["r"] == 1 and got[3]["r"] == 0


def test_secret_scan(docs, empty):
    got = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    kinds = lambda i: [(secret_scan.KINDS[s["rank"]], s["start"], s["end"]) for s in got[i]["base"]]
    want = re.compile(secret_scan.ASSIGN)  # in "secret: token" the value is too short, and the match is consumed
    assert kinds(11) == [("assign", m.start(), m.end()) for m in want.finditer(TEXTS[11]) if len(m[2]) >= 6] and len(kinds(11)) == 1
    assert [k for k, *_ in kinds(12)] == ["access", "hex"] and kinds(0) == []
    assert secret_scan.scan(empty).count() == 0


def test_secret_thresholds_bound_both_errors():
    r = np.random.default_rng(2)
    bins = lambda p: dict(zip(*(x.tolist() for x in np.unique(np.minimum(300, np.floor(-np.log10(p) * 10)).astype(int), return_counts=True))))
    random, ordinary, close = r.uniform(0, 1, 2000), 10.0 ** -r.uniform(4, 30, 4000), r.uniform(0.01, 0.08, 1500)
    t = secret_scan.threshold(bins(np.concatenate([random, ordinary])))
    assert (random <= t).mean() < 0.03 and (ordinary > t).sum() == 0
    t = secret_scan.threshold(bins(np.concatenate([random, ordinary, close])))
    assert (close > t).sum() / ((close > t).sum() + (random > t).sum()) < 0.2 and (random > t).mean() > 0.85
    assert secret_scan.threshold({0: 1}) < 0.5 and secret_scan.threshold({120: 1}) >= 1e-12  # alone: one kept, one dismissed


@pytest.mark.parametrize("alphabet", ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_planted_random_tokens_are_found(spark, alphabet):
    r = np.random.default_rng(len(alphabet))
    near = ["averylongidentifier_of_12_words", "some-page-with-a-long-name-2024-05-01", "getUserAccountSettingsFromDatabase2", "AAAAAAAAAAAAAAAAAAAA1111111111", "abcdefghijklmnopqrstuvwxyz0123456789"]
    rows = [(i, "x " + "".join(r.choice(list(alphabet), 20 + i % 21)) + " y") for i in range(200)] + [(1000 + i, f"see {near[i % 5]} there") for i in range(200)]
    found = {x["doc_id"]: x["random"] for x in secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(bool(found[i]) for i in range(200)) >= 185 and sum(bool(s) for i, s in found.items() if i >= 1000) <= 20


def test_language_id(spark, docs):
    en, de = "the cat and the house with this thing ", "der Hund und das Haus mit für schön ß "
    df = spark.createDataFrame([(i, (en if i % 2 else de) * 3 + str(i), "en" if i % 2 else "de") for i in range(120)], "doc_id bigint, text string, lang string")
    net = langid.train(df, "text", "lang", "doc_id")
    got = langid.identify(df, net, keep=("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 115
    odd = spark.createDataFrame([(1, None), (2, "123 !"), (3, "")], "doc_id bigint, text string")
    assert {r["lang_pred"] for r in langid.identify(odd, net).collect()} == {"und"}
    assert langid.train(df.limit(0), "text", "lang", "doc_id") is None


def test_toxicity(spark, docs, empty):
    df = spark.createDataFrame([(i, f"some plain text number w{i} " + ("you idiot moron" if i % 4 == 0 else "kind regards")) for i in range(200)], "doc_id bigint, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).filter("doc_id < 150")
    trained = toxicity.train(df, labels)
    got = {r["doc_id"]: r for r in toxicity.score(df, trained, evidence=True).collect()}
    assert all((got[i]["score"] >= 0.7) == (i % 4 == 0) for i in got) and got[0]["evidence"][0]["label"] == 1
    clash = toxicity.score(df.withColumn("score", F.lit("mine")), trained, keep=("doc_id", "score"), into="other").first()
    assert clash["score"] == "mine" and 0 <= clash["other"] <= 1
    untrained = toxicity.train(empty, labels.limit(0))
    assert all(r["score"] < 0.7 for r in toxicity.score(docs, untrained).collect()) and toxicity.score(docs, trained).count() == docs.count()


def test_toxicity_counts_terms(spark):
    texts = [None, "", "a-b, Réêou RÉÊOU x1y abcdefg abcdefgh", "abcd " * 3, "nothing known"]
    terms = sorted({t for x in toxicity.terms_of(pa.array(texts[:4])) for t in x})
    assert terms == sorted(["a", "b", "x", "y", "réêou", "abcd", "abcdefg", "abcdefgh", "^abc", "^abcde", "^réê"])
    got = toxicity.Vocabulary(pa.array(terms)).counts(pa.array(texts).slice(1))
    want = toxicity.terms_of(pa.array(texts[1:]))
    assert [{terms[i]: c for i, c in zip(at, n)} for at, n in got] == [{t: c for t, c in w.items() if t in terms} for w in want]


@pytest.mark.parametrize("common", [1, 16, 10**9])
def test_toxicity_neighbours_are_exact(common, monkeypatch):
    """Blocks, columns and posting lists against every cosine."""
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    r = np.random.default_rng(4)
    none = np.zeros(0, np.int64)

    def draw():
        at = np.unique(r.zipf(1.3, 30) % 400)
        return at, r.integers(1, 4, len(at))

    examples = [(i, int(i % 7 == 0), draw()) for i in range(150)] + [(200 + i, 0, (none, none)) for i in range(3)]
    df = np.bincount(np.concatenate([e[0] for _, _, e in examples]), minlength=401)
    index = toxicity.Index(df, len(examples), examples)
    queries = [draw() for _ in range(90)] + [(none, none), (np.array([400]), np.array([1]))]
    for q, near in zip(queries, index.nearest(queries), strict=True):
        at, w = index.vector(q)
        ask = np.zeros(401)
        ask[at] = w
        full = np.zeros(len(index.examples))
        for i, (_, _, e) in enumerate(index.examples):
            at, w = index.vector(e)
            full[i] = ask[at] @ w
        assert [s for s, _ in near] == pytest.approx(sorted(full[full > 0], reverse=True)[: toxicity.NEAREST], abs=1e-5)
        assert all(full[i] == pytest.approx(s, abs=1e-5) for s, i in near)


def test_mixing():
    assert mixing.shares(10, [1, 1], [2, 100]) == [2, 8] and mixing.shares(0, [1.0], [5]) == [0]
    tokens = {("a", "en", "x"): 10, ("a", "en", "y"): 100, ("b", "en", "z"): 1000}
    got = mixing.budgets(tokens, mixing.Target(budget=200, weight=lambda path, n: 1.0))
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 90, ("b", "en", "z"): 100}


def test_mixing_takes_its_budget(docs, empty):
    rows = mixing.mix(docs, mixing.Target(share=1.0, weight=lambda p, n: 1.0, epochs=2)).collect()
    assert sum(r["taken"] for r in rows) == docs.select(F.sum(mixing.n_tokens(F.col("text")))).first()[0]
    assert all(0 <= r["taken"] <= r["n_tokens"] for r in rows) and mixing.mix(empty).count() == 0


def test_quality(docs, empty):
    got = quality.classify(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(empty).count() == 0


def test_token_store_words_equal_the_library():
    import public_tokenizers

    from querywatch.llm import token_store as ts

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    chars = [chr(c) for c in range(33, 0x250) if not chr(c).isspace()]
    for text in [f"{c} {c}, a{c} {c}A. AB{c}!? {c * 3}_" for c in chars] + ["İ, J̌!x ΑΣ, don't I'M.", "<|endoftext|>, A</w>,b", "", "a <|startoftext|> b<|endoftext|>", "<|ENDOFTEXT|> x", "x y …, a", "é, ≮ a̸b", "\x1ca\x85b"]:
        assert ts.encode_texts([text], path, 2)[0].tolist() == [*own.encode(text, add_special_tokens=False).ids, 2]
