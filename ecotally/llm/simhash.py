"""SimHash near-duplicates by anchor-point covering.

A text's 64-bit fingerprint has a bit set where more than half of its
shingles' hashes do.  Fingerprints link at ``bits`` (4) or fewer differing
bits.  The bits are cut into two blocks of 31 and two left over; of two linked
fingerprints at least one block differs in 2 bits or fewer.  In each block the
anchors are the words of the Hamming(31, 26) code, which has covering radius
1: the midpoint of a linked pair of blocks lies within 1 of an anchor, so both
ends lie within 2 of it (radius plus half the block's threshold).  Every
distinct fingerprint is replicated to all anchors within 2 (16 at most per
block), and fingerprints are compared within each anchor.

Inside an anchor, groups grow from link to link: each fingerprint is compared
with those not yet reached, so a dense group needs few comparisons, and only
the links that join it (one fewer than its members) go on.  An anchor of more
than ``CHUNK`` fingerprints is split into chunks that are compared pair by
pair in tasks of their own.

Results of odd input: a null or blank text has fingerprint 0, linked like any
other; a text of fewer words than a shingle is one shingle; repeated rows
share fingerprint and component; a null id never becomes a component id unless
all ids of a component are null; an empty table gives an empty result; further
columns are carried along by ``deduplicated``, clashing ones replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Aside, add_columns, plain_words, stored
from .components import connected

SHINGLE = 4
BITS = 4
BLOCK = 31
CHUNK = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text."""
    import numpy as np  # noqa: PLC0415
    from xxhash import xxh64_intdigest  # noqa: PLC0415

    words = plain_words(text, lower=True)
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxh64_intdigest(line, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-shingle]]).tolist()
        stops = (ends[shingle - 1:] - 1).tolist()
        h = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
    ones = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    import pyarrow as pa  # noqa: PLC0415

    return add_columns(docs, [text], [("fp", "long", pa.int64())], lambda: lambda texts: ([fingerprint(t, shingle) for t in texts],))


def _syndromes(x):
    """Syndrome of each 31-bit word: the XOR of the positions (1 to 31) set."""
    import numpy as np  # noqa: PLC0415

    s = np.zeros(len(x), np.uint64)
    for i in range(BLOCK):
        s ^= ((x >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s.astype(np.int64)


def _flips():
    """For each syndrome the error patterns of weight 0 to 2 that have it, so
    that a word with it, XOR a pattern, is a code word within 2."""
    import numpy as np  # noqa: PLC0415

    table = np.full((32, 16), -1, np.int64)
    table[0, 0] = 0
    for s in range(1, 32):
        pairs = sorted({tuple(sorted((i, i ^ s))) for i in range(1, 32) if i ^ s})
        table[s] = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs]
    return table


def anchors(fps):
    """(anchor keys, row index) of fingerprints (uint64 array): every code
    word within 2 of each block; a key holds block number and code word."""
    import numpy as np  # noqa: PLC0415

    flips, keys, rows = _flips(), [], []
    for block in (0, 1):
        x = (fps >> np.uint64(block * BLOCK)) & np.uint64((1 << BLOCK) - 1)
        patterns = flips[_syndromes(x)]
        words = x.astype(np.int64)[:, None] ^ patterns
        r, c = np.nonzero(patterns >= 0)
        keys.append(words[r, c] | (block << 40))
        rows.append(r)
    return np.concatenate(keys), np.concatenate(rows)


def _replicated(nodes: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415

        for b in batches:
            fps = b.column(0).to_numpy()
            keys, rows = anchors(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["anchor", "fp"])

    return nodes.select("fp").mapInArrow(run, "anchor long, fp long")


def joining_links(fps, bits: int) -> list[tuple[int, int]]:
    """The links that join the fingerprints of an array into their groups.

    Groups grow from link to link; a member is compared only with the
    fingerprints that no group has reached yet."""
    import numpy as np  # noqa: PLC0415

    free, out = np.unique(fps), []
    while len(free) > 1:
        todo, free = [free[0]], free[1:]
        while todo and len(free):
            at = todo.pop()
            near = np.bitwise_count((free ^ at).view(np.uint64)) <= bits
            if near.any():
                hit = free[near]
                out += [(int(at), int(x)) for x in hit]
                todo += list(hit)
                free = free[~near]
    return out


def _linked(rows: DataFrame, bits: int) -> DataFrame:
    """Joining links of each (anchor, i, j) group of rows (anchor, i, j, fp).

    Rows arrive sorted by group; the links of a task are thinned to a forest
    before they go on."""

    def run(batches):
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415

        root: dict[int, int] = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def links_of(key, fps, cuts):
            out = []
            starts, stops = np.array(cuts[:-1]), np.array(cuts[1:])
            for g in np.flatnonzero(stops - starts > 1).tolist():
                some = fps[starts[g]:stops[g]]
                if len(some) == 2:  # most groups
                    a, b = int(some[0]), int(some[1])
                    pairs = [(a, b)] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits else []
                else:
                    pairs = joining_links(some, bits)
                for a, b in pairs:
                    x, y = find(a), find(b)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((a, b))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

        key, fps = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)  # the group that may go on in the next batch
        for b in batches:
            key = np.concatenate([key, np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)])
            fps = np.concatenate([fps, b.column(3).to_numpy()])
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            yield links_of(key, fps, cuts)
            key, fps = key[cuts[-1]:], fps[cuts[-1]:]
        yield links_of(key, fps, [0, len(fps)])

    dealt = rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return dealt.select("anchor", "i", "j", "fp").mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) that join all fingerprints of ``nodes`` (distinct ``fp``)
    at ``bits`` or fewer differing bits into their groups."""
    if bits > 5:
        raise ValueError("two blocks of 31 bits find links of at most 5 differing bits")
    copies = _replicated(nodes)
    sizes = copies.groupBy("anchor").count().filter(F.col("count") > chunk)  # at most rows / chunk anchors
    large = stored(sizes.select("anchor", F.ceil(F.col("count") / F.lit(chunk)).cast("int").alias("n")), "large-anchors")
    if large.isEmpty():
        return _linked(copies.selectExpr("anchor", "0 AS i", "0 AS j", "fp"), bits)
    rows = copies.join(large, "anchor", "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1))).cast("int"))
    pair = F.expr("""explode(CASE WHEN n IS NULL THEN array(named_struct('i', 0, 'j', 0)) ELSE transform(sequence(0, n - 1),
        k -> named_struct('i', least(k, mine), 'j', greatest(k, mine))) END)""")
    return _linked(rows.select("anchor", "fp", pair.alias("p")).selectExpr("anchor", "p.i AS i", "p.j AS j", "fp"), bits)


def components(fingerprints: DataFrame, doc_id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """(fp, root, component_id) for every distinct ``fp``: the smallest
    document id reachable."""
    nodes = stored(fingerprints.groupBy("fp").agg(F.min(doc_id).alias("first")), "fingerprints")
    roots = stored(connected(links(nodes, bits)), "roots")
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(ids, "root").select("fp", "root", "component_id")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per document: ``fingerprint`` (hex) and ``component_id``."""
    prints = stored(with_fingerprints(docs.select(doc_id, text), text, shingle).select(doc_id, "fp"), "prints")
    found = components(prints, doc_id, bits)
    return prints.join(found, "fp").select(doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One document of each group (the one of smallest id) with its columns."""
    aside = Aside(docs, [doc_id, text])
    prints = stored(with_fingerprints(aside.rows, text, shingle), "documents-fp")
    found = components(prints.select(doc_id, "fp"), doc_id, bits)
    ids = prints.select(F.col(doc_id).alias("_id"), "fp").distinct()
    best = ids.join(found, "fp").groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "fp")).alias("b"))
    best = stored(best.select(F.col("b._id").alias("_id"), F.col("b.fp").alias("_bfp")), "kept-documents")
    rows = prints.join(best, prints[doc_id].eqNullSafe(best["_id"]) & (prints["fp"] == best["_bfp"]), "left_semi")
    one = W.partitionBy(doc_id, "fp").orderBy(F.xxhash64(text))
    return aside.restored(rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1"))
