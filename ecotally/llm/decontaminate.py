"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are compiled into one suffix automaton over words
(several, when the benchmark is larger than ``SHARD_WORDS``).  Training texts
stream through it: after each word the automaton knows the longest run of
words, ending there, that occurs in some item.  A run of ``window`` or more
words is a hit; an item shorter than the window counts as one window of its
own length.

Results of odd input: a null or empty text has no words, no hits and is never
contaminated; a null or empty item has no window; repeated items are all
named; an empty benchmark leaves every document clean; documents with equal
ids are judged row by row; further columns are carried along unless they clash
with a result column, which then wins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER_DIGIT_BYTES, Aside, add_columns, lower_words, stored

WINDOW = 13
#: Words of test items that one automaton holds (about 1 KB of memory each).
SHARD_WORDS = 200_000
#: Automata of one pass over the documents; a larger benchmark takes several passes, each written to the shared folder.
PASS_SHARDS = 4


class SuffixAutomaton:
    """Generalised suffix automaton over the words of test items.

    ``least[v]``: shortest match length at which state ``v`` reports
    something, ``window_items[v]``: items that hold the state's ``window``-word
    string, ``short[v]``: (length, items) of short items that end here and
    ``up[v]``: the next state with short items on the suffix path.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(str(i), lower_words(t)) for i, t in items]
        for _, words in texts:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.link)
        self.window = window
        self.window_items: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for item, words in texts:
            state = 0
            for k, w in enumerate(words, 1):
                state = self.next[state][w]
                at = state
                while self.length[self.link[at]] >= window:
                    at = self.link[at]
                if k >= window:
                    self.window_items.setdefault(at, set()).add(item)
                    state = at
            if 0 < len(words) < window:
                self.short.setdefault(state, (len(words), set()))[1].add(item)
        self.up, self.least = [-1] * n, [1 << 30] * n
        for v in sorted(range(1, n), key=self.length.__getitem__):
            p = self.link[v]
            self.up[v] = p if p in self.short else self.up[p]
            best = 1 << 30 if p <= 0 else self.least[p]
            if v in self.short:
                best = min(best, self.short[v][0])
            if self.length[v] >= window:
                best = min(best, window)
            self.least[v] = best

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(link)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        twin = len(link)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = twin
            p = link[p]
        return twin

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of words inside an occurrence of a window, in
        order and merged, and the items whose windows occur."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        root = nxt[0]
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        seen: set[int] = set()
        state = n = 0
        here = root
        for i, w in enumerate(words):
            if w in here:
                state = here[w]
                n += 1
            elif w not in root:
                if n:
                    state = n = 0
                    here = root
                continue
            else:
                while w not in nxt[state]:
                    state = link[state]
                n = length[state] + 1
                state = nxt[state][w]
            here = nxt[state]
            if n >= least[state]:
                self._report(i, state, n, spans, items, seen)
        return spans, items

    def _report(self, i, state, n, spans, items, seen) -> None:
        v, longest = state, 0
        if n >= self.window:
            longest = n  # every window of the run occurs
            while self.length[self.link[v]] >= self.window:
                v = self.link[v]
            if v not in seen:
                seen.add(v)
                items |= self.window_items.get(v, set())
        v = state if state in self.short else self.up[state]
        while v > 0:
            size, names = self.short[v]
            if size <= n:
                longest = max(longest, size)
                items |= names
            v = self.up[v]
        if longest:
            start = i + 1 - longest
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, i + 1))


def shards(items: DataFrame, item_id: str, text: str, shard_words: int = SHARD_WORDS) -> Iterator[list[tuple]]:
    """The test items in groups of about ``shard_words`` words.

    The group count follows from the size of the benchmark, which is measured
    first; the driver holds the groups of one pass at a time."""
    sized = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).filter("t IS NOT NULL")
    total = sized.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // (6 * shard_words)))
    place = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n if total else 0):
        yield [tuple(r) for r in sized.filter(place == k).collect()]


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
            shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``spans`` (word positions that
    windows cover, merged) and ``found_items`` (sorted)."""
    import pyarrow as pa  # noqa: PLC0415

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    fields = [("n_words", "long", pa.int64()), ("spans", "array<struct<start:int,end:int>>", span),
              ("found_items", "array<string>", pa.list_(pa.string()))]
    out, reads, n = docs, [text], 0
    for group in shards(items, item_id, item_text, shard_words):
        if n and n % PASS_SHARDS == 0:  # the automata of one pass are all that tasks and driver hold
            out = stored(out, "benchmark-matches")
        out = add_columns(out, reads, fields, _matcher(group, window))
        reads, n = [text, "spans", "found_items"], n + 1
    if not n:
        out = add_columns(out, reads, fields, _matcher([], window))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.withColumn("n_hit", hit)


def _matcher(group: list[tuple], window: int):
    def make():
        automaton = SuffixAutomaton(group, window)

        def match(texts, before=None, items_before=None):
            counts, spans, items = [], [], []
            for k, t in enumerate(texts):
                words = lower_words(t)
                s, i = automaton.scan(words) if automaton.next[0] else ([], set())
                if before is not None:  # what earlier automata found
                    s = _merged([(x["start"], x["end"]) for x in before[k]] + s)
                    i |= set(items_before[k])
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in s])
                items.append(sorted(i))
            return counts, spans, items

        return match

    return make


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contaminated(share: int = 20):
    """Coverage rule: one word in ``share`` or more lies in a hit."""
    return (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))


def judged(docs: DataFrame, items: DataFrame, share: int = 20, **kw) -> DataFrame:
    """``matches`` with the verdict ``contaminated``."""
    return matches(docs.drop("contaminated"), items, **kw).withColumn("contaminated", contaminated(share))


def cut_spans(found: DataFrame, text: str = "text", longest: int = WINDOW) -> DataFrame:
    """``clean_text``: the text without the spans of ``longest`` words or more
    (the length limit); the separators around a span stay."""

    import pyarrow as pa  # noqa: PLC0415

    def make():
        return lambda texts, spans: ([_without(t, s, longest) for t, s in zip(texts, spans)],)

    return add_columns(found, [text, "spans"], [("clean_text", "string", pa.string())], make)


def _without(text, spans, longest):
    spans = [(s["start"], s["end"]) for s in spans] if spans is not None else []
    spans = [s for s in spans if s[1] - s[0] >= longest]
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    plain = raw.translate(LETTER_DIGIT_BYTES)
    bounds, at = [], 0
    for w in plain.split():
        at = plain.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last:bounds[a][0]])
        last = bounds[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminated(docs: DataFrame, items: DataFrame, share: int = 20, text: str = "text", longest: int = WINDOW,
                   n_chars: str | None = None, **kw) -> DataFrame:
    """The documents that the coverage rule leaves, with their own columns,
    without the spans of ``longest`` words or more that a few hits cover; a
    column ``n_chars`` is counted anew where a text was cut."""
    aside = Aside(docs, [text])
    left = judged(aside.rows, items, share, text=text, **kw).filter(~F.col("contaminated"))
    cut = cut_spans(left, text, longest).withColumn(text, F.col("clean_text"))
    out = aside.restored(cut)
    if n_chars in aside.others:
        kind = docs.schema[n_chars].dataType
        was = F.col(aside.pack)[n_chars]
        counted = F.when(F.size("spans") > 0, F.char_length(text).cast(kind)).otherwise(was)
        out = aside.restored(cut.withColumn(aside.pack, F.col(aside.pack).withField(f"`{n_chars}`", counted)))
    return out


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: counts, item count and the SHA-256 of the item
    ids, sorted as strings and joined by commas."""
    return found.select(
        doc_id, "n_words", "n_hit", F.size("found_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found_items"), 256).alias("items_sha256"), "contaminated",
    )

