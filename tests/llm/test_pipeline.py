"""The pipeline's stages against plain Python, each on its own input."""

import brute
import pytest
import rows
from test_corpus_operators import want_tokens

import corpus_pipeline as pipeline
from ecotally.llm import decontaminate, mixing, toxicity
from ecotally.llm.common import id_remainder

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage returned, written and read again like run() does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def pairs(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_keep_the_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[1:-1])


def test_toxic_documents_go(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(id_remainder("doc_id", 4) != 2)
    scored = toxicity.scored(steps[0], toxicity.fit(steps[0], labels))
    assert pairs(steps[1]) == pairs(scored.filter("score < 0.3")) and len(pairs(steps[1])) < len(pairs(steps[0]))


def test_one_document_of_each_group_stays(steps):
    before = pairs(steps[1])
    groups = brute.groups([(d, brute.fingerprint(t)) for d, t in before])
    assert pairs(steps[2]) == [r for r, g in zip(before, groups) if r[0] == g]


def test_contaminated_documents_go(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute.contamination(pairs(steps[2]), items)
    bad = {d for d, (n, hit, _) in found.items() if hit and 20 * len(hit) >= n}
    after = pairs(steps[3])
    assert bad and [d for d, _ in after] == [d for d, _ in pairs(steps[2]) if d not in bad]
    texts = dict(after)
    for d, t in pairs(steps[2]):
        if d not in bad:
            hit = runs(found[d][1])
            words = brute.ALNUM.findall((t or "").translate(brute.LOWER))
            assert brute.ALNUM.findall((texts[d] or "").translate(brute.LOWER)) == [w for k, w in enumerate(words) if k not in hit]
            assert hit or texts[d] == t
    changed = steps[3].filter("n_chars <> char_length(text)").count()
    assert changed == steps[2].join(steps[3].select("doc_id"), "doc_id", "left_semi").filter("n_chars <> char_length(text)").count()


def runs(hit, longest=13):
    """The positions of ``hit`` in runs of 13 or more."""
    out, run = set(), []
    for k in [*sorted(hit), None]:
        if run and k != run[-1] + 1:
            out |= set(run) if len(run) >= longest else set()
            run = []
        run.append(k)
    return out


def test_short_hits_in_long_documents_are_cut(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike"
    filler = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(1, f"{filler}. {item.title()}, {filler}", 5), (2, item, 3), (3, filler, 9)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([("a", item)], "item_id string, text string")
    out = {r["doc_id"]: r for r in decontaminate.decontaminated(docs, items, n_chars="n_chars").collect()}
    assert set(out) == {1, 3} and out[1]["text"] == f"{filler}. , {filler}" and out[1]["n_chars"] == len(out[1]["text"])
    assert (out[3]["text"], out[3]["n_chars"]) == (filler, 9) and list(out[3].asDict()) == docs.columns


def test_benchmark_in_several_passes(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda df: sorted(map(str, df.select("doc_id", "n_words", "spans", "found_items").collect()))
    monkeypatch.setattr(decontaminate, "PASS_SHARDS", 2)
    assert key(decontaminate.matches(docs, items, shard_words=300)) == key(decontaminate.matches(docs, items))


def test_sources_are_mixed(steps):
    counted = {r["doc_id"]: r["n_copies"] for r in mixing.with_counts(steps[3], seed=pipeline.SEED).collect()}
    want = sorted(r for r in pairs(steps[3]) for _ in range(counted[r[0]]))
    assert pairs(steps[4]) == want and len(want) > len(set(want))


def test_token_files_hold_the_mix(steps):
    alone = {}
    for d, t in pairs(steps[4]):
        _, n, crc = want_tokens([(d, t)])[d]
        alone.setdefault(d, []).append((n, crc))
    got = sorted(tuple(r) for r in steps[5].select("start", "n_tokens", "ids_crc32", "doc_id").collect())
    back, at = {}, 0
    for start, n, crc, d in got:
        assert start == at
        at += n
        back.setdefault(d, []).append((n, crc))
    assert {d: sorted(x) for d, x in back.items()} == {d: sorted(x) for d, x in alone.items()}
    order = [d for _, _, _, d in got]
    assert order != sorted(order)


def test_run_gives_the_last_stage(spark, steps):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(pipeline.run(spark, SF)) == key(steps[5])


def test_odd_rows_pass_every_stage(spark, tmp_path):
    for name, docs in (("odd", rows.table(spark, rows.odd_rows())), ("none", rows.empty(spark))):
        for step, (_, stage) in enumerate(pipeline.STAGES):
            columns = docs.columns
            path = str(tmp_path / f"{name}{step}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert step == 4 or docs.columns == columns
