"""Language ID by nearest centroid.

A text's vector counts its byte trigrams (lower-cased letters, other ASCII as
one blank) in ``DIMS`` hashed dimensions, weighted ``(1 + ln tf) * idf`` and
normalised.  Document frequencies cover all training texts.  Each language is
clustered into ``CLUSTERS`` centroids (spherical k-means) on at most about
``SAMPLE`` training texts of that language, chosen by hash; a text goes to the
language of the centroid of largest cosine, and is ``rejected`` when it lies
farther from that centroid than nearly all of the centroid's own sample.

Results of odd input: a null text or one without a letter is ``und`` with
score 0; repeated rows get a row each; a table without training rows learns
nothing and predicts ``und``; languages with one text have one centroid; equal
cosines go to the first language in alphabetical order; further columns are
carried along, clashing ones replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

DIMS = 4096
CLUSTERS = 3
SAMPLE = 400
ROUNDS = 8
#: Share of a centroid's own sample that may lie beyond its rejection distance, and the slack added to it.
REJECT_TAIL, REJECT_SLACK = 0.01, 0.1
NONE = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


#: Byte table: lower-case letters and non-ASCII characters, the rest blank.
LETTER_BYTES = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def counts_of(text: str | None):
    """Trigram counts in hashed dimensions (float32)."""
    import numpy as np  # noqa: PLC0415

    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(LETTER_BYTES).split()
    raw = b" " + b" ".join(words) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(DIMS, np.float32)
    code = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    return np.bincount(code % np.uint32(DIMS), minlength=DIMS).astype(np.float32)


def tfidf(texts, idf):
    """Normalised TF-IDF rows."""
    import numpy as np  # noqa: PLC0415

    x = np.stack([counts_of(t) for t in texts])
    on = x > 0
    x[on] = 1 + np.log(x[on])
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def document_frequencies(train: DataFrame, text: str):
    """(idf, training texts): every training text counts."""
    import numpy as np  # noqa: PLC0415

    def run(batches):
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415

        seen, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                seen += counts_of(t) > 0
                n += 1
        on = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1), pa.int64()), pa.array(np.append(seen[on], n), pa.int64())], names=["dim", "n"])

    rows = train.select(text).mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    seen, n = np.zeros(DIMS), 0
    for dim, k in rows:  # at most DIMS + 1 rows
        if dim < 0:
            n = k
        else:
            seen[dim] = k
    return (np.log((1 + n) / (1 + seen)) + 0.05).astype(np.float32), n


def spherical_kmeans(x, k: int, rounds: int = ROUNDS):
    """Centroids (unit rows): farthest-point start, then Lloyd rounds."""
    import numpy as np  # noqa: PLC0415

    c = x.mean(axis=0)
    picks = [x[int(np.argmax(x @ c))]]
    while len(picks) < min(k, len(x)):
        near = np.max(np.stack([x @ p for p in picks]), axis=0)
        picks.append(x[int(np.argmin(near))])
    c = np.stack(picks)
    for _ in range(rounds):
        mine = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (mine == j).any():
                v = x[mine == j].mean(axis=0)
                c[j] = v / max(np.linalg.norm(v), 1e-9)
    return c


def fit(train: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
        clusters: int = CLUSTERS, sample: int = SAMPLE) -> dict:
    """Model: idf, languages, centroids and their rejection cosines."""
    import numpy as np  # noqa: PLC0415

    train = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("t"), F.col(lang).alias("l"), F.col(doc_id).alias("d"))
    idf, n = document_frequencies(train, "t")
    if not n:
        return {"idf": idf, "langs": [], "centroids": np.zeros((0, DIMS), np.float32), "floor": np.zeros(0, np.float32)}
    sizes = train.groupBy("l").count()
    part = F.pmod(F.xxhash64("d", "t"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = train.join(F.broadcast(sizes), "l").filter(part * F.col("count") < sample).select("t", "l")

    def cluster(pdf):
        import pandas as pd  # noqa: PLC0415

        x = tfidf(list(pdf["t"]), idf)
        c = spherical_kmeans(x, clusters)
        cos = x @ c.T
        mine = np.argmax(cos, axis=1)
        floor = [float(np.quantile(cos[mine == j, j], REJECT_TAIL)) - REJECT_SLACK if (mine == j).any() else 0.0
                 for j in range(len(c))]
        return pd.DataFrame({"l": pdf["l"].iloc[0], "c": [v.astype("<f4").tobytes() for v in c], "floor": floor})

    rows = sorted(few.groupBy("l").applyInPandas(cluster, "l string, c binary, floor double").collect(), key=lambda r: (r[0], r[1]))
    return {"idf": idf, "langs": [r[0] for r in rows],
            "centroids": np.stack([np.frombuffer(r[1], "<f4") for r in rows]) if rows else np.zeros((0, DIMS), np.float32),
            "floor": np.array([r[2] for r in rows], np.float32)}


def identified(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``."""
    import pyarrow as pa  # noqa: PLC0415

    fields = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64()), ("rejected", "boolean", pa.bool_())]

    def make():
        import numpy as np  # noqa: PLC0415

        langs, c = model["langs"], model["centroids"]

        def predict(texts):
            pred, score, far = [], [], []
            for lo in range(0, len(texts), 512):
                some = texts[lo:lo + 512]
                ok = [bool(langs) and has_letter(t) for t in some]
                cos = tfidf(some, model["idf"]) @ c.T if langs else np.zeros((len(some), 1), np.float32)
                best = np.argmax(cos, axis=1)
                for k, j in enumerate(best.tolist()):
                    value = min(1.0, max(0.0, float(cos[k, j]))) if ok[k] else 0.0
                    pred.append(langs[j] if ok[k] else NONE)
                    score.append(value)
                    far.append(not ok[k] or value < float(model["floor"][j]))
            return pred, score, far

        return predict

    return add_columns(docs, [text], fields, make)
