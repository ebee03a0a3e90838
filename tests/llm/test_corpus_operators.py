"""Mixing, token files, substring dedup, SimHash, components and the HMM."""

import functools
import math
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ecotally.llm import components, hmm, mixing, phrases, queries, simhash, tokens

SF = "/root/testdata/sf0.001"


# --- mixing -------------------------------------------------------------------

def test_mix_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(mixing.SQL)
    names = [c[0] for c in cur.description]
    got = queries.op2_poisson_mix(spark, SF).collect()
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(cur.fetchall())
    assert [r["place"] for r in got] == sorted(r["place"] for r in got)


def test_poisson_inverse(spark):
    """Against the summed distribution."""
    pairs, want = [], []
    for rate in (0.4, 3.0, 75.5, 260.0, 900.0):
        mass = [math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(int(rate + 15 * math.sqrt(rate) + 40))]
        sums = np.cumsum(mass)
        for u in (1e-9, 0.01, 0.25, 0.5, 0.75, 0.99, 1 - 1e-9):
            pairs.append((rate, u))
            want.append(int((sums <= u).sum()))
    got = spark.createDataFrame(pairs, "rate double, u double").coalesce(1).select(mixing.poisson_inverse("rate", "u")).collect()
    assert [r[0] for r in got] == want
    assert spark.createDataFrame([(0.0, 0.5)], "rate double, u double").select(mixing.poisson_inverse("rate", "u")).first()[0] == 0


def test_poisson_inverse_of_a_large_rate(spark):
    import time

    df = spark.createDataFrame([(1e6, k / 50 + 0.01) for k in range(50)], "rate double, u double")
    df.select(mixing.poisson_inverse("rate", "u")).collect()
    began = time.time()
    got = [r[0] for r in df.select(mixing.poisson_inverse("rate", "u")).collect()]
    assert time.time() - began < 50  # 50 numbers, under a second each
    assert got == sorted(got) and abs(np.median(got) - 1e6) < 100 and abs(np.std(got) - 1000) < 150


def test_mix_reaches_target_weights(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "IF(id % 4 < 3, 'big', 'small') AS source")
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "s string, w double")
    n = dict(mixing.mixed(docs, weights).groupBy("source").count().collect())
    assert abs(n["big"] - 10_000) < 400 and abs(n["small"] - 10_000) < 400


def test_mix_of_odd_rows(spark, monkeypatch):
    odd = rows.table(spark, rows.odd_rows())
    broadcast = mixing.with_counts(odd)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)  # many sources: salted join
    salted = mixing.with_counts(odd)
    key = lambda df: sorted(map(str, df.select("doc_id", "source", "rate", "n_copies").collect()))
    assert broadcast.count() == 12 and key(broadcast) == key(salted)
    out = mixing.mixed(odd)
    assert set(odd.columns) <= set(out.columns) and out.filter("score <> 'own score'").count() == 0
    assert mixing.mixed(rows.empty(spark)).count() == 0
    nothing = spark.createDataFrame([("a", 0.0)], "s string, w double")
    assert mixing.mixed(odd, nothing).count() == 0


# --- token files ----------------------------------------------------------------

@functools.cache
def whole_text_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def want_tokens(doc_rows):
    tok, out, at = whole_text_tokenizer(), {}, 0
    for d, t in sorted(doc_rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]
        out[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def test_token_files_round_trip(spark, doc_rows):
    got = {r[0]: tuple(r)[1:] for r in queries.op6_token_output(spark, SF).collect()}
    assert got == want_tokens(doc_rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzAZéÉàßİΣσςÖ'’.,!?<|># \n\t\x0b\x1c\xa0　́̊019中ñ´÷×—…"), max_size=40))
def test_words_encode_like_the_whole_text(text):
    want = [*whole_text_tokenizer().encode(text, add_special_tokens=False).ids, tokens.END_ID]
    ids, offsets = tokens.encoder().encode(pa.array([text, None, text]))
    assert ids.tolist() == [*want, tokens.END_ID, *want] and offsets.tolist() == [0, len(want), len(want) + 1, 2 * len(want) + 1]


def test_other_vocabularies_encode_whole_texts(doc_rows):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    tok, some = Tokenizer.from_file(path), [t or "" for _, t in doc_rows[:20]]
    other = tokens.encoder(path)
    ids, offsets = other.encode(pa.array(some))
    assert not other.by_words and tokens.encoder().by_words
    for k, t in enumerate(some):
        assert ids[offsets[k]:offsets[k + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, tokens.END_ID]


def test_chunks_hold_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 50, None, "", "b" * 500, "c", "d" * 90])], names=["i", "t"])
    got = list(tokens.in_chunks(b, 1, 100))
    assert [x for c in got for x in c.column(0).to_pylist()] == list(range(6)) and len(got) > 2


def test_token_files_of_odd_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    odd = rows.table(spark, rows.odd_rows())
    tokens.write_tokens(odd, path)
    back = tokens.read_tokens(spark, path).orderBy("start").collect()
    assert len(back) == 12 and [r["doc_id"] for r in back] == sorted((r[0] for r in rows.odd_rows()), key=lambda x: (x is not None, x or 0))
    ends = 0
    for r in back:
        assert r["start"] == ends and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == tokens.END_ID
        ends += r["n_tokens"]
    assert next(r for r in back if r["doc_id"] == 2)["ids"] == [tokens.END_ID]
    bloom = spark.read.orc(path).filter("doc_id = 7")
    assert bloom.count() == 1
    assert tokens.round_trip(rows.empty(spark)).count() == 0


def rows_read(df):
    """Rows that the file scan of a collected DataFrame handed on."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


def test_readers_skip_rows_by_index_and_bloom_filter(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = spark.range(8_000).selectExpr("2 * id AS doc_id", "concat('text ', id) AS text").repartitionByRange(1, "doc_id")
    tokens.write_tokens(docs, path)
    assert rows_read(spark.read.orc(path)) == 8_000
    assert rows_read(spark.read.orc(path).filter("doc_id = 7000")) <= tokens.ROW_STRIDE  # the row index
    there = spark.read.orc(path).filter("doc_id BETWEEN 6000 AND 7999")
    assert there.count() == 1_000 and rows_read(there.select("doc_id")) <= 2 * tokens.ROW_STRIDE
    absent = sum(rows_read(spark.read.orc(path).filter(f"doc_id = {k}")) for k in range(101, 3101, 300))
    assert absent <= tokens.ROW_STRIDE  # ids in range but absent: the Bloom filters
    assert rows_read(spark.read.orc(path).filter("doc_id = 99999")) == 0  # stripe statistics


# --- substring dedup --------------------------------------------------------------

def kept(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()}


@pytest.mark.parametrize("patterns", [phrases.PATTERNS, 40])
def test_repeats_equal_brute_force(spark, docs, doc_rows, patterns):
    want = brute.repeats(doc_rows)
    assert kept(phrases.without_repeats(docs, patterns=patterns)) == want and sum(v[1] for v in want.values()) > 1000


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=6))
def test_small_repeats_equal_brute_force(spark, lists):
    data = [(k, " ".join(x)) for k, x in enumerate(lists)]
    got = phrases.without_repeats(spark.createDataFrame(data, "doc_id long, text string"), window=4, gram=2, patterns=2)
    assert kept(got) == brute.repeats(data, 4)


def test_repeats_of_odd_rows(spark):
    out = phrases.without_repeats(rows.table(spark, rows.odd_rows())).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert len(out) == 12 and by[None] == [(24, 0)] and by[1] == [(24, 24)] and by[5] == [(24, 24)] * 2
    assert by[6] == [(27, 24)] and by[2] == by[3] == by[4] == [(0, 0)] and by[7] == [(60_000, 0)]
    assert phrases.without_repeats(rows.empty(spark)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("phrase")]


def test_repeats_keep_ids_beside_null_ids(spark):
    big = 2**53 + 1
    data = [(None, rows.STORY), (big, rows.STORY), (big + 1, rows.STORY + " more"), (-big, rows.STORY)]
    out = kept(phrases.without_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(1)))
    assert {d: v[1] for d, v in out.items()} == {None: 0, big: 24, big + 1: 24, -big: 24}
    names = [(None, rows.STORY), ("b", rows.STORY), ("a", "x " + rows.STORY)]
    out = kept(phrases.without_repeats(spark.createDataFrame(names, "doc_id string, text string")))
    assert {d: v[1] for d, v in out.items()} == {None: 0, "a": 24, "b": 24}


def test_repeats_in_rows_of_one_id(spark):
    """Rows of one id with different texts: equal windows at one place stay in both."""
    other = " ".join(f"z{k}" for k in range(30))
    data = [(1, rows.STORY), (1, rows.STORY), (1, other), (2, other), (3, rows.STORY)]
    out = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in
                 phrases.without_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert out == [(1, 24, 0), (1, 24, 0), (1, 30, 0), (2, 30, 30), (3, 24, 24)]


# --- SimHash ------------------------------------------------------------------------

def test_simhash_equals_brute_force(spark, doc_rows):
    got = {r[0]: (r[1], r[2]) for r in queries.op9_simhash_anchors(spark, SF).collect()}
    prints = [(d, brute.fingerprint(t)) for d, t in doc_rows]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(prints, brute.groups(prints))}
    assert got == want and len({v[1] for v in want.values()}) < len(want)


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.lists(st.integers(0, 63), max_size=4), min_size=1, max_size=25), st.sampled_from([20_000, 3]))
def test_every_link_is_found(spark, base, flips, chunk):
    prints, f = [], base
    for k, bits in enumerate(flips):
        f = f if k % 3 else base
        for b in bits:
            f ^= 1 << b
        prints.append((k, f))
    signed = [(d, f - 2**64 if f >= 2**63 else f) for d, f in prints]
    nodes = spark.createDataFrame(signed, "doc_id long, fp long")
    edges = [(a % 2**64, b % 2**64) for a, b in simhash.links(nodes.select("fp").distinct(), chunk=chunk).collect()]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in edges)
    root = {f: f for _, f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    got = [find(f) for _, f in prints]
    want = brute.groups(prints)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_anchors_cover_two_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    for a in x[:50]:
        for _ in range(5):
            i, j = rng.integers(0, 31, 2)
            b = a ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j))
            keys = [set(simhash.anchors(np.array([v]))[0].tolist()) for v in (a, b)]
            assert keys[0] & keys[1]


def test_simhash_of_odd_rows(spark):
    odd = rows.table(spark, rows.odd_rows())
    out = simhash.grouped(odd).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 12 and by[5]["component_id"] == by[1]["component_id"] == 1
    assert by[2]["fingerprint"] == "0" * 16 and by[4]["component_id"] == by[3]["component_id"] == 2
    one = simhash.deduplicated(odd)
    assert one.columns == odd.columns and one.filter("fp <> 'own fp'").count() == 0
    ids = [r["doc_id"] for r in one.collect()]
    assert len(ids) == len(set(ids)) and {1, 2, 7} <= set(ids) and not {3, 4, 5, None} & set(ids)
    assert simhash.grouped(rows.empty(spark)).count() == simhash.deduplicated(rows.empty(spark)).count() == 0
    twins = spark.createDataFrame([(1, rows.STORY), (1, rows.STORY), (1, "something else entirely")], "doc_id long, text string")
    assert simhash.deduplicated(twins).count() == 2


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components_equal_union_find(spark, edges):
    got = dict(components.connected(spark.createDataFrame(edges, "u long, v long")).collect())
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


# --- hidden Markov model ---------------------------------------------------------------

def test_base_scores_equal_brute_force(spark, doc_rows):
    got = {r["doc_id"]: r for r in queries.op10_hmm_score(spark, SF).collect()}
    want = brute.unigrams(doc_rows, lambda d: brute.crc(d) % 5 == 1)
    assert set(got) == set(want)
    for d, (n, known, train, base) in want.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, train, brute.crc(d) % 5 == 1)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def small_model(states=3, seed=0):
    rng = np.random.default_rng(seed)
    emit = rng.uniform(0.1, 1, (states, hmm.CLASSES))
    move = rng.uniform(0.1, 1, (states, states))
    return {"first": np.full(states, 1 / states), "move": move / move.sum(1, keepdims=True), "emit": emit / emit.sum(1, keepdims=True),
            "prior": np.full(hmm.CLASSES, 1 / hmm.CLASSES)}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.integers(0, hmm.CLASSES - 1), min_size=1, max_size=5), min_size=1, max_size=5))
def test_forward_and_expected_counts_sum_over_all_paths(lists):
    import itertools

    m = small_model()
    seqs = [np.array(x, np.uint16) for x in lists]
    first, moves, emissions = np.zeros(3), np.zeros((3, 3)), Counter()
    logs = []
    for s in lists:
        paths = {}
        for path in itertools.product(range(3), repeat=len(s)):
            p = m["first"][path[0]] * m["emit"][path[0], s[0]]
            for a, b, w in zip(path, path[1:], s[1:]):
                p *= m["move"][a, b] * m["emit"][b, w]
            paths[path] = p
        total = sum(paths.values())
        logs.append(math.log(total))
        for path, p in paths.items():
            first[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for a, w in zip(path, s):
                emissions[a, w] += p / total
    assert np.allclose(hmm.forward(m, seqs), logs, rtol=1e-4)
    f, t, e = hmm.expected_counts(m, seqs)
    assert np.allclose(f, first, rtol=1e-3) and np.allclose(t, moves, rtol=1e-3, atol=1e-5)
    assert all(math.isclose(e[k], v, rel_tol=1e-3, abs_tol=1e-5) for k, v in emissions.items()) and math.isclose(e.sum(), sum(map(len, lists)), rel_tol=1e-4)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 50, 60).astype(np.uint16) + (100 * (k % 2)) for k in range(20)]
    seqs = [s.astype(np.uint16) for s in seqs]
    model, last = hmm.start_model(np.bincount(np.concatenate(seqs), minlength=hmm.CLASSES), 2), -math.inf
    for _ in range(6):
        now = hmm.forward(model, seqs).sum()
        assert now > last - 1
        last, model = now, hmm.updated(model, *hmm.expected_counts(model, seqs))


def test_hmm_of_odd_rows(spark):
    odd = rows.table(spark, rows.odd_rows()).withColumn("held_out", F.col("doc_id") == 1)
    out = hmm.scored(odd, rounds=1).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 12 and by[2]["n_tokens"] == by[4]["n_tokens"] == 1 and by[1]["n_known"] == 25
    assert by[None]["held_out"] and all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert hmm.scored(rows.empty(spark).withColumn("held_out", F.lit(False))).count() == 0
    one_block = spark.createDataFrame([(None, "a b", False), (2**53 + 1, "a b c", False), (2**53, None, True)], "doc_id long, text string, held_out boolean")
    assert {r["doc_id"] for r in hmm.scored(one_block.coalesce(1), rounds=1).collect()} == {None, 2**53 + 1, 2**53}
    unlearned = hmm.scored(rows.table(spark, rows.odd_rows()).withColumn("held_out", F.lit(True))).collect()
    assert len(unlearned) == 12 and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in unlearned)
