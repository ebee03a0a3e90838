"""Language-model scores from a hidden Markov model.

Vocabulary: tokens of the training documents are counted through a shuffle on
the token; every document block learns the counts of its own tokens back, so
no vocabulary is ever whole in one place.  Model: ``STATES`` latent states
emit ``CLASSES`` hashed token classes, and a class emits its tokens in the
proportion of their smoothed counts; so the chance of a text is the chance of
its class sequence (the scaled forward recursion, exact) times the chance of
each token within its class.  Training is Baum-Welch: a start from pieces of
about ``SAMPLE_TOKENS`` tokens, then rounds whose expected counts are summed
over all training documents (cut into pieces of ``PIECE`` tokens, all of them
used), until a round adds less than ``GAIN`` to the log likelihood of a token,
``ROUNDS`` at most.

Results of odd input: a null or empty text is its end token alone; a null id
counts as held out (its remainder is unknown); repeated rows get a row each
and are learned as often; a table without training rows gives every token the
chance its smoothing leaves; further columns are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, pieces, plain_words, scratch, stored

STATES = 8
CLASSES = 4096
ROUNDS = 12
GAIN = 0.002
SAMPLE_TOKENS = 250_000
SAMPLE_ROUNDS = 25
PIECE = 1024
#: Tokens of a block: documents that learn their tokens' counts together.
BLOCK_TOKENS = 4_000_000
#: Pieces of training text that one forward-backward pass takes together.
PASS_TOKENS = 1_000_000
END = b""


def _packed(docs: DataFrame, doc_id: str, text: str, held: str, buckets: int) -> str:
    """Writes, below the returned path, ``kind=doc`` rows (a document's tokens
    as positions in its block's token list, and as classes) and ``kind=words``
    rows (a block's tokens of one bucket with their training counts)."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415
        from pyspark import TaskContext  # noqa: PLC0415
        from xxhash import xxh64_intdigest  # noqa: PLC0415

        names = ["kind", "block", "bucket", "doc_id", "held_out", "positions", "classes"]
        part, flushed = TaskContext.get().partitionId(), 0
        id_arrow = None
        index: dict[bytes, int] = {}
        rows: list[tuple] = []

        def flush():
            nonlocal flushed
            words = list(index)
            h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
            cls = (h % np.uint64(CLASSES)).astype(np.uint16)
            bucket = ((h >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            block = part * 1_000_000 + flushed
            learned = [ids for _, held_out, ids in rows if not held_out] or [np.zeros(0, np.int32)]
            counts = np.bincount(np.concatenate(learned), minlength=len(words))
            for lo in range(0, len(rows), 512):
                some = rows[lo:lo + 512]
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["doc"] * n), pa.array([block] * n, pa.int64()), pa.nulls(n, pa.int32()),
                     pa.array([r[0] for r in some], id_arrow), pa.array([r[1] for r in some], pa.bool_()),
                     pa.array([place[r[2]].astype("<i4").tobytes() for r in some], pa.binary()),
                     pa.array([cls[r[2]].astype("<u2").tobytes() for r in some], pa.binary())], names=names)
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            some = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["words"] * n), pa.array([block] * n, pa.int64()), pa.array([k for k, _ in some], pa.int32()),
                 pa.nulls(n, id_arrow), pa.nulls(n, pa.bool_()),
                 pa.array([b" ".join([words[i] for i in o.tolist()]) for _, o in some], pa.binary()),
                 pa.array([counts[o].astype("<i8").tobytes() for _, o in some], pa.binary())], names=names)
            flushed += 1
            index.clear()
            rows.clear()

        total = 0
        for b in batches:
            id_arrow = b.schema.field(0).type
            for d, t, held_out in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = plain_words(t, lower=True)
                words.append(END)
                for w in words:
                    if w not in index:
                        index[w] = len(index)
                rows.append((d, held_out, np.fromiter(map(index.__getitem__, words), np.int32, len(words))))
                total += len(words)
                if total >= BLOCK_TOKENS:
                    yield from flush()
                    total = 0
        if rows:
            yield from flush()

    path = scratch(docs.sparkSession, "packed")
    schema = f"kind string, block long, bucket int, doc_id {id_type}, held_out boolean, positions binary, classes binary"
    rows = docs.select(doc_id, text, F.coalesce(F.col(held), F.lit(True)).alias("_held")).mapInArrow(run, schema)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return path


def _counted(words: DataFrame) -> DataFrame:
    """Per (block, bucket) the counts of its tokens over all blocks, and per
    bucket (block -1) the totals and distinct tokens of each class."""

    def count(pdf):
        import numpy as np  # noqa: PLC0415
        import pandas as pd  # noqa: PLC0415
        from xxhash import xxh64_intdigest  # noqa: PLC0415

        total: dict[bytes, int] = {}
        lists = [blob.split(b" ") for blob in pdf["positions"]]
        for some, blob in zip(lists, pdf["classes"]):
            for w, n in zip(some, np.frombuffer(blob, "<i8").tolist()):
                total[w] = total.get(w, 0) + n
        out = [np.fromiter(map(total.__getitem__, some), "<i8", len(some)).tobytes() for some in lists]
        known = [(w, n) for w, n in total.items() if n]
        cls = np.fromiter((xxh64_intdigest(w) % CLASSES for w, _ in known), np.int64, len(known))
        n = np.bincount(cls, weights=[x for _, x in known], minlength=CLASSES)
        v = np.bincount(cls, minlength=CLASSES).astype(float)
        return pd.DataFrame({"block": [*pdf["block"], -1], "bucket": pdf["bucket"].iloc[0],
                             "counts": [*out, np.concatenate([n, v]).astype("<f8").tobytes()]})

    return words.select("block", "bucket", "positions", "classes").groupBy("bucket").applyInPandas(
        count, "block long, bucket int, counts binary")


def _class_totals(counted: DataFrame):
    """(tokens, distinct tokens) per class, summed by tasks, not the driver."""
    import numpy as np  # noqa: PLC0415

    def spread(batches):
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415

        total = np.zeros(2 * CLASSES)
        for b in batches:
            for blob in b.column(0).to_pylist():
                total += np.frombuffer(blob, "<f8")
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["slot", "n"])

    rows = counted.filter("block = -1").select("counts").mapInArrow(spread, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n"))
    total = np.zeros(2 * CLASSES)
    for slot, n in rows.collect():  # at most 2 * CLASSES rows
        total[slot] = n
    return total[:CLASSES], total[CLASSES:]


# --- the hidden Markov model ------------------------------------------------

def start_model(class_tokens, states: int = STATES, seed: int = 11) -> dict:
    """Sticky states whose emissions differ from the class shares by noise."""
    import numpy as np  # noqa: PLC0415

    rng = np.random.default_rng(seed)
    prior = (class_tokens + 1) / (class_tokens + 1).sum()
    emit = prior * rng.uniform(0.5, 1.5, (states, CLASSES))
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return {"first": np.full(states, 1 / states), "move": move, "emit": emit / emit.sum(axis=1, keepdims=True), "prior": prior}


def _padded(seqs):
    """Sequences in order of falling length: (order, lengths, offsets, flat
    classes step by step, sequences alive at each step)."""
    import numpy as np  # noqa: PLC0415

    lengths = np.array([len(s) for s in seqs])
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max())
    alive = np.searchsorted(-lengths[order], -np.arange(longest), side="left")  # sequences longer than t
    offsets = np.concatenate([[0], np.cumsum(alive)])
    flat = np.empty(offsets[-1], np.uint16)
    for rank, k in enumerate(order.tolist()):
        flat[offsets[:lengths[k]] + rank] = seqs[k]
    return order, offsets.tolist(), flat


def forward(model: dict, seqs, keep: bool = False):
    """Natural log likelihood of each sequence by the scaled recursion; with
    ``keep`` also what the backward pass needs."""
    import numpy as np  # noqa: PLC0415

    order, offsets, flat = _padded(seqs)
    move = model["move"].astype(np.float32)
    emit = np.ascontiguousarray(model["emit"].T.astype(np.float32))
    logs = np.zeros(len(seqs))
    kept = np.empty((len(flat), len(move)), np.float32) if keep else None
    scales = np.empty(len(flat), np.float32) if keep else None
    a = None
    for t, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
        n = hi - lo
        a = (np.broadcast_to(model["first"].astype(np.float32), (n, len(move))) if t == 0 else a[:n] @ move) * emit[flat[lo:hi]]
        scale = a.sum(axis=1)
        a /= scale[:, None]
        logs[:n] += np.log(scale)
        if keep:
            kept[lo:hi], scales[lo:hi] = a, scale
    out = np.empty(len(seqs))
    out[order] = logs
    return (out, offsets, flat, kept, scales) if keep else out


def expected_counts(model: dict, seqs):
    """Baum-Welch counts of some sequences: (first, moves, emissions)."""
    return counts_and_likelihood(model, seqs)[:3]


def counts_and_likelihood(model: dict, seqs):
    """Baum-Welch counts of some sequences and their log likelihood: (first,
    moves, emissions, log likelihood)."""
    import numpy as np  # noqa: PLC0415

    logs, offsets, flat, alpha, scales = forward(model, seqs, keep=True)
    move = model["move"].astype(np.float32)
    back = np.ascontiguousarray(move.T)
    emit = np.ascontiguousarray(model["emit"].T.astype(np.float32))
    states = len(move)
    moves = np.zeros((states, states))
    beta = np.ones((offsets[-1] - offsets[-2], states), np.float32)
    for t in range(len(offsets) - 2, -1, -1):
        lo, hi = offsets[t], offsets[t + 1]
        n = hi - lo
        if n > len(beta):  # sequences that end at this step
            beta = np.concatenate([beta, np.ones((n - len(beta), states), np.float32)])
        if t:
            ahead = emit[flat[lo:hi]] * beta / scales[lo:hi, None]
            before = alpha[offsets[t - 1]:offsets[t - 1] + n]
            moves += before.T @ ahead
            alpha[lo:hi] *= beta
            beta = ahead @ back
        else:
            alpha[lo:hi] *= beta
    emissions = np.stack([np.bincount(flat, weights=alpha[:, s], minlength=CLASSES) for s in range(states)])
    return alpha[:offsets[1]].sum(axis=0, dtype=float), moves * model["move"], emissions, np.array(logs.sum())


def updated(model: dict, first, moves, emissions) -> dict:
    """Model of the expected counts, smoothed so that nothing has chance 0."""
    first, moves = first + 0.1, moves + 0.1
    emissions = emissions + 400 * model["prior"]
    return {"first": first / first.sum(), "move": moves / moves.sum(axis=1, keepdims=True),
            "emit": emissions / emissions.sum(axis=1, keepdims=True), "prior": model["prior"]}


def _cut(blob: bytes):
    import numpy as np  # noqa: PLC0415

    s = np.frombuffer(blob, "<u2")
    return [s[i:i + PIECE] for i in range(0, len(s), PIECE)]


def train(train_docs: DataFrame, class_tokens, rounds: int = ROUNDS, states: int = STATES, gain: float = GAIN) -> dict:
    """Baum-Welch over ``train_docs`` (columns ``doc_id`` and ``classes``)."""
    import numpy as np  # noqa: PLC0415

    model = start_model(class_tokens, states)
    tokens = float(class_tokens.sum())
    if not tokens:
        return model
    size = 2 * PIECE  # bytes of a piece
    piece = F.explode(F.expr(f"sequence(0, (length(classes) - 1) div {size})"))
    part = F.pmod(F.xxhash64("doc_id", "classes", "k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = train_docs.filter("length(classes) > 0").select("doc_id", "classes", piece.alias("k")).filter(part * tokens < SAMPLE_TOKENS)
    few = few.select(F.expr(f"substring(classes, k * {size} + 1, {size}) AS classes"), F.lit(0).alias("g"))

    def begin(pdf):
        import pickle  # noqa: PLC0415

        import pandas as pd  # noqa: PLC0415

        m = model
        seqs = [s for blob in sorted(pdf["classes"]) for s in _cut(blob)]
        for _ in range(SAMPLE_ROUNDS):
            m = updated(m, *expected_counts(m, seqs))
        return pd.DataFrame({"m": [pickle.dumps(m)]})

    import pickle  # noqa: PLC0415

    got = few.groupBy("g").applyInPandas(begin, "m binary").collect()  # one row: the model
    model = pickle.loads(got[0][0]) if got else model
    sizes = [states, states * states, states * CLASSES, 1]
    before = None
    for _ in range(rounds):
        def count(batches, model=model):
            import numpy as np  # noqa: PLC0415
            import pyarrow as pa  # noqa: PLC0415

            total, seqs, held = np.zeros(sum(sizes)), [], 0
            for b in batches:
                for blob in b.column(0).to_pylist():
                    seqs += _cut(blob)
                    held += len(blob) // 2
                    if held >= PASS_TOKENS:
                        total += np.concatenate([x.ravel() for x in counts_and_likelihood(model, seqs)])
                        seqs, held = [], 0
            if seqs:
                total += np.concatenate([x.ravel() for x in counts_and_likelihood(model, seqs)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["slot", "n"])

        rows = train_docs.select("classes").mapInArrow(count, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n")).collect()
        total = np.zeros(sum(sizes))
        for slot, value in rows:  # one row for each model parameter
            total[slot] = value
        first, moves, emissions, likely = np.split(total, np.cumsum(sizes)[:-1])
        model = updated(model, first, moves.reshape(states, states), emissions.reshape(states, CLASSES))
        if before is not None and (likely[0] - before) / tokens < gain:
            break
        before = likely[0]
    return model


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held: str = "held_out", rounds: int = ROUNDS,
           states: int = STATES) -> DataFrame:
    """Per document: n_tokens, n_known, train_tokens, base_score (smoothed
    unigrams) and score, both log10; ``held`` marks rows not to learn from."""
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    path = _packed(docs, doc_id, text, held, buckets=2 * pieces(docs.select(doc_id, text)))
    schema = f"block long, bucket int, doc_id {id_type}, held_out boolean, positions binary, classes binary"
    packed = spark.read.schema(schema + ", kind string").parquet(path)
    rows = packed.filter("kind = 'doc'").select("block", "doc_id", "held_out", "positions", "classes")
    counted = stored(_counted(packed.filter("kind = 'words'")), "counts")
    class_tokens, class_words = _class_totals(counted)
    n, v = float(class_tokens.sum()), float(class_words.sum())
    model = train(rows.filter("NOT held_out").select("doc_id", "classes"), class_tokens, rounds, states)

    def score(docs_of, counts_of):
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415

        counts = np.frombuffer(b"".join(counts_of.sort_by("bucket").column("counts").to_pylist()), "<i8")
        logs = np.log10(counts + 0.5)
        within = np.log10(class_tokens + 0.5 * (class_words + 1))
        whole = np.log10(n + 0.5 * (v + 1))
        seqs = [np.frombuffer(x, "<u2") for x in docs_of.column("classes").to_pylist()]
        ids = [np.frombuffer(x, "<i4") for x in docs_of.column("positions").to_pylist()]
        tokens = np.array([len(s) for s in seqs], np.int64)
        words = np.array([logs[i].sum() for i in ids], float)
        chain = forward(model, seqs) / np.log(10) if seqs else np.zeros(0)
        return pa.table({
            "doc_id": docs_of.column("doc_id"), "held_out": docs_of.column("held_out"), "n_tokens": tokens,
            "n_known": pa.array([int((counts[i] > 0).sum()) for i in ids], pa.int64()),
            "train_tokens": pa.array([int(n)] * len(seqs), pa.int64()), "base_score": words - tokens * whole,
            "score": chain + words - np.array([within[s].sum() for s in seqs], float)})

    return rows.groupBy("block").cogroup(counted.filter("block >= 0").groupBy("block")).applyInArrow(
        score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ).withColumnRenamed("doc_id", doc_id)


def held_out(doc_id: str = "doc_id"):
    """The rows that the model doesn't learn from."""
    return id_remainder(doc_id, 5) == 1
