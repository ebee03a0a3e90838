"""Substring dedup with repeated-phrase automata.

A phrase is ``WINDOW`` (20) consecutive words of one document; every word
covered by a phrase that also starts earlier (smaller document id, or the same
document before) goes.

1. Documents are dealt into blocks (a bucketed table, read by the later steps
   without another shuffle).  Each window has an anchor, the ``GRAM``-word
   string in it of smallest hash, so equal windows have equal anchors; about
   one word in six starts one.  Blocks send their distinct anchors to buckets,
   which answer which of them occur twice or more anywhere.
2. Consecutive windows around one occurrence of a recurring anchor form a
   segment.  A block sends the windows of its distinct segments, as 128-bit
   hashes with their places, to the shard of their hash.  A shard confirms
   which of them recur and which place is a phrase's first, and tells the
   blocks; the hash spreads any phrase's neighbourhood over all shards, and a
   block sends a segment once however often it holds it.
3. A block compiles the confirmed passages of its segments (runs of recurring
   windows; over several segments where the block has them once) into
   Aho-Corasick automata of at most ``PATTERNS`` passages each
   and streams all its documents through them.  The automata locate every
   occurrence: a window of a document lies in a segment, and equal segments
   hold equal passages.  Places that are a phrase's first stay; the words
   covered by the other occurrences are dropped.

Results of odd input: a null or empty text has no words; texts under 20 words
are kept whole; rows with equal ids count as one document, so equal windows at
the same place of two such rows stay in both; a null id comes before all
others; an empty table gives an empty result; further columns are not carried
along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, scratch, stored, words_of

WINDOW = 20
GRAM = 10
PATTERNS = 20_000
#: Symbols that one automaton may hold besides.
PATTERN_SYMBOLS = 1_500_000
#: Symbols of one automaton step: a word's number is written with two of them, from ranges that don't meet, so that no
#: node of the automaton has many children and no match begins inside a word.
BASE = 512

#: Of a window: it recurs; its place is the first; it is the first of its segment; its segment occurs again in the block.
RECURS, FIRST, STARTS, AGAIN = 1, 2, 4, 8


class Block:
    """The documents of a block, in order of their ids: words and numbers."""

    def __init__(self, ids, texts, window: int, gram: int):
        import numpy as np  # noqa: PLC0415

        self.window, self.gram, self.ids = window, gram, ids
        self.words, self.begins = words_of(texts)
        coded = self.words.dictionary_encode()
        self.numbers, self.vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.doc_of = np.repeat(np.arange(len(self.begins) - 1), np.diff(self.begins))

    def _word_hashes(self):
        """Two hashes of each word, one after the other."""
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415
        from xxhash import xxh3_128_digest  # noqa: PLC0415

        words = self.vocabulary.cast(pa.large_binary()).to_pylist()
        h = np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(-1, 2)
        return h[:, 0][self.numbers], h[:, 1][self.numbers]

    @staticmethod
    def _mixed(h):
        import numpy as np  # noqa: PLC0415

        h = h ^ (h >> np.uint64(29))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def _polynomial(self, a):
        """Prefix sums of a polynomial in an odd base modulo 2^64, and the
        powers that shift a part of it back."""
        import numpy as np  # noqa: PLC0415

        n, base = len(a), 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
        if n:
            up[0] = down[0] = 1
        powers, back = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(a * powers, dtype=np.uint64)]), back

    def _strings(self, polynomial, starts, sizes):
        """Hashes of the strings of ``sizes`` words at ``starts``."""
        sums, back = polynomial
        return self._mixed((sums[starts + sizes] - sums[starts]) * back[starts])

    def segments(self) -> None:
        """Anchors, and the segments (first window, windows) that share them."""
        import numpy as np  # noqa: PLC0415

        total, window, gram = len(self.numbers), self.window, self.gram
        one, other = self._word_hashes()
        self.one, self.other = self._polynomial(one), self._polynomial(other)
        n, span = max(0, total - window + 1), window - gram + 1
        sums, back = self.one
        # the low bits of a gram's hash give way to its place in the window: of equal ones the first is the least
        free = np.uint64((1 << (span - 1).bit_length()) - 1)
        grams = self._mixed((sums[gram:] - sums[:len(sums) - gram]) * back[:max(0, total - gram + 1)]) & ~free if n else sums[:0]
        low = grams[:n].copy()
        for j in range(1, span):
            np.minimum(low, grams[j:j + n] | np.uint64(j), out=low)
        at = (low & free).astype(np.int64)
        low &= ~free
        start = np.arange(n)
        inside = self.doc_of[:n] == self.doc_of[window - 1:] if n else np.zeros(0, bool)
        start, at, low = start[inside], (start + at)[inside], low[inside]
        # windows next to each other that share an anchor's place belong together
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        self.anchor, self.start = low[first], start[first]
        self.count = np.diff(np.append(first, len(start)))

    def distinct_anchors(self, buckets: int):
        """(anchors, counts, place of each segment's anchor among them,
        bucket bounds), in order of bucket and value."""
        import numpy as np  # noqa: PLC0415

        u, inverse, counts = np.unique(self.anchor, return_inverse=True, return_counts=True)
        bucket = (u % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(u), np.int64)
        place[order] = np.arange(len(u))
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        return u[order], counts[order], place[inverse], bounds

    def distinct_windows(self, recurring):
        """The windows of the distinct segments whose anchors recur: (hash,
        other hash, start, whether its segment occurs again in the block,
        whether it is its segment's first)."""
        import numpy as np  # noqa: PLC0415

        on = np.flatnonzero(recurring)
        start, count = self.start[on], self.count[on]
        sizes = count + self.window - 1
        key = np.stack([self._strings(self.one, start, sizes), self._strings(self.other, start, sizes), count.astype(np.uint64)])
        order = np.lexsort((start, *key))
        same = (key[:, order[1:]] == key[:, order[:-1]]).all(axis=0)
        heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), ~same]))
        times = np.diff(np.append(heads, len(order)))
        start, count = start[order[heads]], count[order[heads]]
        total = int(count.sum())
        begin = np.cumsum(count) - count
        w = np.arange(total) - np.repeat(begin, count) + np.repeat(start, count)
        head = np.zeros(total, bool)
        head[begin] = True
        return self._strings(self.one, w, self.window), self._strings(self.other, w, self.window), w, np.repeat(times > 1, count), head

    def located(self, starts, flags, patterns: int):
        """Which words are covered, given the confirmed windows of the block's
        distinct segments: their starts, ascending, and flags."""
        import itertools  # noqa: PLC0415

        import ahocorasick  # noqa: PLC0415
        import numpy as np  # noqa: PLC0415

        total, window = len(self.numbers), self.window
        if not len(starts):
            return np.zeros(total, bool)
        text = np.empty(2 * total, "<u4")
        text[0::2] = 0x10000 + self.numbers // BASE
        text[1::2] = 0x100 + self.numbers % BASE
        text = text.tobytes().decode("utf-32-le")
        # a passage ends with its segment if that or the next one is somewhere else in the block too: it may go on otherwise
        # there; segments that occur once make long passages
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (flags[1:] & STARTS > 0) & ((flags[1:] | flags[:-1]) & AGAIN > 0)
        heads = np.flatnonzero(new)
        ends = starts[np.append(heads[1:], len(starts)) - 1] + window
        passages = sorted({text[2 * a:2 * b] for a, b in zip(starts[heads].tolist(), ends.tolist())})
        depth = np.zeros(total + 1, np.int64)
        for group in _groups(passages, patterns):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in group:
                automaton.add_word(p)
            automaton.make_automaton()
            found = np.fromiter(itertools.chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2)
            last, size = found[:, 0] // 2, found[:, 1] // 2
            first = last + 1 - size
            whole = self.doc_of[first] == self.doc_of[last]  # not over the end of a document
            depth += np.bincount(first[whole], minlength=total + 1)
            depth -= np.bincount((first + size - window + 1)[whole], minlength=total + 1)
        again = np.cumsum(depth[:-1]) > 0
        again[self._first_places(starts[flags & FIRST > 0])] = False
        at = np.flatnonzero(again)
        cover = np.bincount(at, minlength=total + 1) - np.bincount(at + window, minlength=total + 1)
        return np.cumsum(cover[:-1]) > 0

    def _first_places(self, first):
        """``first`` with the equal windows at the same places of rows of equal ids."""
        import numpy as np  # noqa: PLC0415

        out = [first]
        rows = {}
        for k, x in enumerate(self.ids.to_pylist()):
            rows.setdefault(x, []).append(k)
        shared = {k: ks for ks in rows.values() if len(ks) > 1 for k in ks}
        for s in first.tolist() if shared else []:
            for k in shared.get(int(self.doc_of[s]), ()):
                t = int(self.begins[k] + s - self.begins[self.doc_of[s]])
                if t + self.window <= self.begins[k + 1] and (self.numbers[t:t + self.window] == self.numbers[s:s + self.window]).all():
                    out.append(np.array([t]))
        return np.concatenate(out)


def _groups(passages: list[str], patterns: int):
    """The passages of one automaton after the other."""
    group, symbols = [], 0
    for p in passages:
        if group and (len(group) >= patterns or symbols + len(p) > PATTERN_SYMBOLS):
            yield group
            group, symbols = [], 0
        group.append(p)
        symbols += len(p)
    if group:
        yield group


def _blocks(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(block, id, text) bucketed by block, one block per bucket."""
    spark = docs.sparkSession
    # a number for each bucket that Spark's hash puts there
    spots = spark.range(40 * n + 400).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("b")).groupBy("b").agg(F.min("id").alias("id"))
    labels = dict(spots.collect())  # n rows
    if len(labels) < n:
        raise RuntimeError("no label for some bucket")
    block = F.element_at(F.array(*[F.lit(labels[b]).cast("long") for b in range(n)]), (F.pmod(F.xxhash64(doc_id), F.lit(n)) + 1).cast("int"))
    name, path = f"phrase_blocks_{uuid.uuid4().hex}", scratch(spark, "phrase-blocks")
    rows = docs.select(block.alias("block"), F.col(doc_id).alias("id"), F.col(text).alias("text")).repartition(n, "block")
    rows.write.bucketBy(n, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    found = spark.table(name)
    found.schema  # noqa: B018  the plan knows the files from here on
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files stay
    return found


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                    patterns: int = PATTERNS) -> DataFrame:
    """Per document: n_words, n_removed and ``kept_text`` (the words that stay,
    joined by one blank)."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    n = pieces(docs.select(doc_id, text))
    buckets = 2 * n
    blocks = _blocks(docs, doc_id, text, n)

    def ordered(t):
        import pyarrow.compute as pc  # noqa: PLC0415

        t = t.combine_chunks()
        return t.take(pc.sort_indices(t, [("id", "ascending"), ("text", "ascending")], null_placement="at_start"))

    def block_of(t):
        return Block(t.column("id").combine_chunks(), t.column("text").combine_chunks(), window, gram)

    def blob(array, kind):
        return array.astype(kind).tobytes()

    def send_anchors(t):
        import pyarrow as pa  # noqa: PLC0415

        block = block_of(ordered(t))
        block.segments()
        anchors, counts, _, bounds = block.distinct_anchors(buckets)
        rows = [(k, blob(anchors[a:b], "<u8"), blob(counts[a:b], "<u4")) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
        return pa.table({"block": pa.array([t.column("block")[0].as_py()] * len(rows), pa.int64()), "bucket": pa.array([r[0] for r in rows], pa.int32()),
                         "anchors": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    sent = blocks.groupBy("block").applyInArrow(send_anchors, "block long, bucket int, anchors binary, counts binary")

    def count_anchors(t):
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415

        lists = [np.frombuffer(x, "<u8") for x in t.column("anchors").to_pylist()]
        u, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, "<u4") for x in t.column("counts").to_pylist()]), minlength=len(u))
        level = (total >= 2).astype(np.uint8)[inverse]
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"),
                         "levels": pa.array([x.tobytes() for x in np.split(level, cuts)], pa.binary())})

    levels = stored(sent.groupBy("bucket").applyInArrow(count_anchors, "block long, bucket int, levels binary"), "anchor-levels")

    def send_windows(t, level_rows):
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415

        rows = []
        if t.num_rows and level_rows.num_rows:
            block = block_of(ordered(t))
            block.segments()
            levels = b"".join(level_rows.sort_by("bucket").column("levels").to_pylist())
            _, _, place, _ = block.distinct_anchors(buckets)
            h, other, start, twice, head = block.distinct_windows(np.frombuffer(levels, np.uint8)[place] > 0)
            doc = block.doc_of[start]
            shard = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(buckets + 1))
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                if b > a:
                    x = order[a:b]
                    used, number = np.unique(doc[x], return_inverse=True)
                    rows.append((k, blob(h[x], "<u8"), blob(other[x], "<u8"), blob(used, "<u4"), blob(number, "<u4"),
                                 blob(start[x] - block.begins[doc[x]], "<u4"), blob(AGAIN * twice[x] + STARTS * head[x], "u1"),
                                 block.ids.take(pa.array(used))))
        block_id = t.column("block")[0].as_py() if t.num_rows else 0
        kinds = [pa.int32(), *[pa.binary()] * 6]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        ids = pa.concat_arrays([r[7] for r in rows]) if rows else t.column("id").combine_chunks().slice(0, 0)
        offsets = np.concatenate([[0], np.cumsum([len(r[7]) for r in rows])]).astype(np.int32)
        return pa.table([pa.array([block_id] * len(rows), pa.int64()), *columns, pa.ListArray.from_arrays(pa.array(offsets), ids)],
                        names=["block", "shard", "h", "other", "used", "doc", "place", "bits", "ids"])

    windows = blocks.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(
        send_windows, "block long, shard int, h binary, other binary, used binary, doc binary, place binary, bits binary, "
                      f"ids array<{id_type}>")

    def confirm(t):
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415
        import pyarrow.compute as pc  # noqa: PLC0415

        t = t.combine_chunks()
        lists = {c: [np.frombuffer(x, k) for x in t.column(c).to_pylist()]
                 for c, k in (("h", "<u8"), ("other", "<u8"), ("used", "<u4"), ("doc", "<u4"), ("place", "<u4"), ("bits", "u1"))}
        sizes = [len(x) for x in lists["h"]]
        h, other, place, bits = (np.concatenate(lists[c]) for c in ("h", "other", "place", "bits"))
        ids = t.column("ids").combine_chunks().flatten()
        before = np.cumsum([0, *[len(x) for x in lists["used"]]])[:-1]
        rank = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        rank = rank[np.concatenate([x + b for x, b in zip(lists["doc"], before)])]
        order = np.lexsort((place, rank, other, h))
        same = (h[order[1:]] == h[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
        group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
        recurs = np.bincount(group, weights=1 + (bits[order] & AGAIN)) > 1
        flags = np.zeros(len(order), np.uint8)
        flags[order] = np.where(recurs[group], RECURS + FIRST * np.concatenate([np.ones(min(1, len(order)), bool), ~same]), 0)
        flags += np.where(flags > 0, bits, 0).astype(np.uint8)
        out, at = [], 0
        for k, (size, used, doc) in enumerate(zip(sizes, lists["used"], lists["doc"])):
            on = np.flatnonzero(flags[at:at + size])
            if len(on):
                out.append((k, used[doc[on]].tobytes(), place[at:at + size][on].tobytes(), flags[at:at + size][on].tobytes()))
            at += size
        return pa.table({"block": t.column("block").take(pa.array([r[0] for r in out], pa.int64())),
                         **{c: pa.array([r[k] for r in out], pa.binary()) for k, c in ((1, "doc"), (2, "place"), (3, "flags"))}})

    told = stored(windows.groupBy("shard").applyInArrow(confirm, "block long, doc binary, place binary, flags binary"), "phrase-places")

    def remove(t, told_rows):
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415
        import pyarrow.compute as pc  # noqa: PLC0415

        rows = ordered(t)
        block = block_of(rows)
        doc, place, flags = (np.frombuffer(b"".join(told_rows.column(c).to_pylist()), k) for c, k in (("doc", "<u4"), ("place", "<u4"), ("flags", "u1")))
        starts = block.begins[doc] + place
        order = np.argsort(starts, kind="stable")
        stays = ~block.located(starts[order], flags[order], patterns)
        ends = np.concatenate([[0], np.cumsum(stays)])[block.begins]
        kept = pa.LargeListArray.from_arrays(pa.array(ends), block.words.filter(pa.array(stays)))
        n_words = np.diff(block.begins)
        return pa.table({"id": rows.column("id"), "n_words": pa.array(n_words), "n_removed": pa.array(n_words - np.diff(ends)),
                         "kept_text": pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())})

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        remove, f"id {id_type}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", doc_id)
