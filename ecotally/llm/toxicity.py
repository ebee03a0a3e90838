"""Toxicity from a learned lexicon, misspellings included.

Learning: words and word stems that labelled toxic texts hold in several
contexts, and clean ones hardly ever, form the lexicon (a trie).  Matching:
the trie is intersected with Levenshtein automata (one edit for terms of 4
letters or more, two from 8; a swap of neighbours is one edit; stems match
exactly).  The product automaton is made deterministic as it is used, so a
word costs a few table steps.  Scoring: each hit has the smoothed share of
toxic texts among the training texts that hold such a hit, by term, distance
and context (inside quotation marks or not, other hits within ``NEAR`` words
or not): the odds of the term times the likelihood ratio of the context over
all terms, then the counts of the term in that context; a text's score is the
chance that at least one hit is real.  A word that clean texts hold only
inside quotation marks can be a term.

The sample to learn from is bounded: about ``SAMPLE`` toxic and ``SAMPLE``
clean labelled texts, chosen by hash.  Hits and texts without hits count by
the inverse of their class's sampling rate, so scores are shares of the whole
corpus whatever its size.  Inexact hits are rated on one half of
it, after words that clean texts of the other half hold outside quotation
marks have been excepted.

Results of odd input: a null or empty text has no hits and the score of such
texts; a table without labels learns nothing and scores 0 everywhere; several
labels of one id count as toxic if one says so; null labels are left out;
repeated rows get a row each; further columns are carried along, clashing
ones replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, give_back, stored

SAMPLE = 6_000
#: A term is kept when toxic texts would hold it as often by chance with less than this probability.
CHANCE = 1e-6
MIN_SHARE = 0.95
#: Hits less likely than this to be real don't count.
MIN_CHANCE = 0.5
STEM_LENGTHS = range(4, 9)
NEAR = 10
EDGES = "\"'`.,;:!?()[]{}<>«»“”„‘’‚‹›*_~-–—…|/\\#$%&+="
OPENING, CLOSING = frozenset("\"«“„‘‚‹"), frozenset("\"»”“’›")
REMEMBERED = 300_000
#: Words and stems that a learning task holds at a time.
HELD = 50_000
PREDICTED_FROM = 0.3


class Matcher:
    """Trie of terms and stems crossed with Levenshtein automata.

    A state is a set of (trie node, edits used, swap pending); ``steps`` holds
    the transitions found so far and ``ends`` what a word may match when it
    ends in a state: (distance, term)."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.allowed = [0]
        for words, mark in ((terms, self.term), (stems, self.stem)):
            for w in words:
                self._add(w, mark, 0 if mark is self.stem or len(w) < 4 else 1 if len(w) < 8 else 2)
        self._restart()

    def _add(self, word: str, mark: list, edits: int) -> None:
        at = 0
        self.allowed[0] = max(self.allowed[0], edits)
        for c in word:
            if c not in self.child[at]:
                self.child[at][c] = len(self.child)
                self.child.append({})
                self.term.append(None)
                self.stem.append(None)
                self.allowed.append(0)
            at = self.child[at][c]
            self.allowed[at] = max(self.allowed[at], edits)
        mark[at] = word

    def _restart(self) -> None:
        self.sets: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[int, str] | None] = []
        self.whole: list[str | None] = []
        self.start = self._id(self._closed({(0, 0, "")}))

    def _closed(self, states: set) -> frozenset:
        """Adds what leaving out term letters reaches."""
        todo = list(states)
        while todo:
            node, e, swap = todo.pop()
            if swap:
                continue
            for n in self.child[node].values():
                if e < self.allowed[n] and (s := (n, e + 1, "")) not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def _id(self, states: frozenset) -> int:
        if states not in self.ids:
            self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            # two letters more of slack than a term allows would change it into another word
            ends = [(e, self.term[n]) for n, e, s in states if not s and self.term[n] and e <= (0 if len(self.term[n]) < 4 else 1 if len(self.term[n]) < 8 else 2)]
            self.ends.append(min(ends, default=None))
            self.whole.append(min((self.stem[n] for n, e, s in states if not s and not e and self.stem[n]), default=None))
        return self.ids[states]

    def _step(self, at: int, c: str) -> int:
        out = set()
        for node, e, swap in self.sets[at]:
            if swap:  # the second letter of a swap
                if c == swap:
                    out.add((node, e, ""))
                continue
            kids = self.child[node]
            if c in kids:
                out.add((kids[c], e, ""))
            if e < self.allowed[node]:
                out.add((node, e + 1, ""))  # a letter too many
            for a, n in kids.items():
                if e < self.allowed[n]:
                    if a != c:
                        out.add((n, e + 1, ""))  # another letter
                    m = self.child[n].get(c)
                    if a != c and m is not None and e < self.allowed[m]:
                        out.add((m, e + 1, a))  # two letters swapped
        to = self._id(self._closed(out)) if out else -1
        self.steps[at][c] = to
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, distance) of the nearest term; a stem that the word begins
        with is at distance 0."""
        if len(self.sets) > 50_000:
            self._restart()
        at, stem, steps, whole = self.start, None, self.steps, self.whole
        for c in word:
            to = steps[at].get(c)
            if to is None:
                to = self._step(at, c)
            if to < 0:
                return (stem, 0) if stem else None
            at = to
            stem = whole[at] or stem
        end = self.ends[at]
        if stem and (end is None or end[0]):
            return stem, 0
        return (end[1], end[0]) if end else None


def tokens(text: str) -> list[str]:
    return text.lower().split()


def quoted_places(raw: list[str]) -> set[int]:
    """Places of the words inside quotation marks that close within
    ``4 * NEAR`` words."""
    places, since = set(), None
    for i, w in enumerate(raw):
        if w[0] in OPENING and (since is None or i - since >= 4 * NEAR):
            since = i
        if since is not None and w.rstrip(".,;:!?)")[-1:] in CLOSING and (len(w) > 1 or i > since):
            places.update(range(max(since, i - 4 * NEAR + 1), i + 1))
            since = None
    return places


def hits_of(text: str | None, matcher: Matcher, known: dict) -> list[tuple[str, int, str, str]]:
    """Hits of a text: (term, distance, context, the word itself); context is
    two letters: quoted (q/-) and other hits near (n/-)."""
    if not text:
        return []
    raw = tokens(text)
    bare = {}
    for w in set(raw):
        if w in known:
            m = known[w]
        else:
            if len(known) > REMEMBERED:
                known.clear()
            s = w.strip(EDGES)
            m = matcher.find(s) if s else None
            m = known[w] = (m[0], m[1], s) if m else None
        if m:
            bare[w] = m
    if not bare:
        return []
    found = [i for i, w in enumerate(raw) if w in bare]
    closed = quoted_places(raw)
    out = []
    for k, i in enumerate(found):
        near = (k and i - found[k - 1] <= NEAR) or (k + 1 < len(found) and found[k + 1] - i <= NEAR)
        term, distance, word = bare[raw[i]]
        out.append((term, distance, ("q" if i in closed else "-") + ("n" if near else "-"), word))
    return out


def sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, sample: int) -> tuple[DataFrame, dict[int, float]]:
    """(d, t, y), about ``sample`` labelled texts of each class, by hash, and
    the weight of a text of each class, 1 for the class sampled most fully."""
    y = labels.filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("d")).agg(F.max(F.col(toxic).cast("int")).alias("y"))
    sizes = {r[0]: r[1] for r in y.groupBy("y").count().collect()}  # two rows
    part = F.pmod(F.xxhash64("d"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | ((F.col("y") == value) & (part * n < sample))
    ids = y.filter(keep)  # at most about 2 * sample ids
    texts = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).join(F.broadcast(ids), "d")
    inverse = {value: max(1.0, n / sample) for value, n in sizes.items()}
    return texts, {value: w / min(inverse.values()) for value, w in inverse.items()}


def toxic_counts(texts, held: int):
    """Of the words and stems of ``texts``: in how many texts each is, anywhere
    and outside quotation marks.  Given in parts of about ``held`` of them."""
    seen: dict[tuple, list[int]] = {}
    for t in texts:
        plain = {k for w in set(bare_words(t, unquoted=True)) for k in keys_of(w)}
        for k in {k for w in set(bare_words(t)) for k in keys_of(w)}:
            c = seen.setdefault(k, [0, 0])
            c[0] += 1
            c[1] += k in plain
        if len(seen) >= held:
            yield seen
            seen = {}
    yield seen


def toxic_contexts(texts, asked: set, most: int, held: int):
    """Of the words and stems ``asked`` for: up to ``most`` words they come
    after and up to three words they are or begin, in parts like those of
    ``toxic_counts``."""
    seen: dict[tuple, tuple[list, list]] = {}
    for t in texts:
        words = bare_words(t)
        for before, w in set(zip(["", *words], words)):
            for k in keys_of(w):
                if k in asked:
                    for some, one, limit in zip(seen.setdefault(k, ([], [])), (before, w), (most, 3)):
                        if len(some) < limit and one not in some:
                            some.append(one)
        if len(seen) >= held:
            yield seen
            seen = {}
    yield seen


def clean_counts(texts, asked: set):
    """``toxic_counts`` of clean texts, of the words and stems ``asked`` for."""
    clean: dict[tuple, list[int]] = {}
    for t in texts:
        for place, unquoted in enumerate((False, True)):
            for k in {k for w in set(bare_words(t, unquoted)) for k in keys_of(w)}:
                if k in asked:
                    clean.setdefault(k, [0, 0])[place] += 1
    yield clean


def by_key(texts: DataFrame, find, columns: list[str], of: str = "long") -> DataFrame:
    """(stem, k, ``columns``) of what ``find`` gives for each task's texts
    ``t``: dicts of one value a column by (is a stem, text)."""

    def run(batches):
        import pyarrow as pa  # noqa: PLC0415

        kind = pa.int64() if of == "long" else pa.list_(pa.string())
        for seen in find(t.as_py() for b in batches for t in b.column(0)):
            cols = [pa.array([k[0] for k in seen], pa.bool_()), pa.array([k[1] for k in seen], pa.string())]
            cols += [pa.array([c[i] for c in seen.values()], kind) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(cols, names=["stem", "k", *columns])
        give_back()

    return texts.select("t").mapInArrow(run, ", ".join(["stem boolean, k string", *[f"{c} {of}" for c in columns]]))


def learn_lexicon(texts: DataFrame, held: int = HELD) -> tuple[list[str], list[str]]:
    """Terms and stems from sampled (d, t, y).

    Words and stems are counted in the toxic texts first, and of those alone
    that came up often the contexts are gathered; clean texts are then asked
    for those that came up in several contexts.  A task holds about ``held``
    of them at a time.  Toxic texts must hold a term nearly alone, anywhere or
    outside quotation marks.
    The tests compare rates within each class (``ratio``) and ask what chance
    does in this very sample (``least``), so they need no sampling weights."""
    n = {r[0]: r[1] for r in texts.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        return [], []
    least = max(2, math.ceil(math.log(CHANCE) / math.log(n[1] / (n[0] + n[1]))))
    most = -(-least // 2)  # contexts that suffice
    rows = by_key(texts.filter("y = 1"), lambda said: toxic_counts(said, held), ["toxic", "plain"])
    rows = rows.groupBy("stem", "k").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")).filter(F.col("toxic") >= least)
    rows = rows.collect()  # bounded by the sample
    toxic, plain = ({(r["stem"], r["k"]): r[n] for r in rows} for n in ("toxic", "plain"))
    often = set(toxic)

    rows = by_key(texts.filter("y = 1"), lambda said: toxic_contexts(said, often, most, held), ["contexts", "kinds"], "array<string>")
    several = rows.groupBy("stem", "k").agg(*[F.size(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("contexts", "kinds")])
    rows = several.filter((F.col("contexts") >= most) & (~F.col("stem") | (F.col("kinds") >= 3))).select("stem", "k").collect()
    asked = {(r["stem"], r["k"]) for r in rows}
    toxic = {k: c for k, c in toxic.items() if k in asked}

    rows = by_key(texts.filter("y = 0"), lambda said: clean_counts(said, asked), ["clean", "plain"])
    clean = {(r["stem"], r["k"]): (r["n"], r["p"]) for r in rows.groupBy("stem", "k").agg(F.sum("clean").alias("n"), F.sum("plain").alias("p")).collect()}
    ratio = 3 * n[1] / n[0]

    def alone(k: tuple) -> bool:
        anywhere, outside = clean.get(k, (0, 0))
        return toxic[k] >= MIN_SHARE * (toxic[k] + ratio * anywhere) or least <= plain[k] >= MIN_SHARE * (plain[k] + ratio * outside)

    strong = [k for k in toxic if alone(k)]
    strong.sort(key=lambda k: (-toxic[k], k))
    terms = [k for stem, k in strong if not stem]
    stems = [k for stem, k in strong if stem]
    short = set(stems)
    return terms, [s for s in stems if not any(s[:k] in short for k in range(1, len(s)))]


def bare_words(text: str | None, unquoted: bool = False) -> list[str]:
    """Words of three letters or more without the marks at their edges, all or
    those outside quotation marks."""
    raw = tokens(text or "")
    if unquoted and (inside := quoted_places(raw)):
        raw = [w for i, w in enumerate(raw) if i not in inside]
    return [w for w in (x.strip(EDGES) for x in raw) if len(w) >= 3]


def keys_of(word: str) -> list[tuple[bool, str]]:
    """The word itself and its stems, as (is a stem, text)."""
    return [(False, word), *[(True, word[:k]) for k in STEM_LENGTHS if len(word) >= k]]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        sample: int = SAMPLE) -> dict:
    """Model from labelled rows (the caller leaves out what is held out)."""
    texts, weight = sampled(docs, labels, doc_id, text, toxic, sample)
    texts = stored(texts, "toxicity-sample")
    terms, stems = learn_lexicon(texts)

    def run(batches):
        import pyarrow as pa  # noqa: PLC0415

        matcher, known = Matcher(terms, stems), {}
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        for b in batches:
            rows = []
            for t, y, half in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("t", "y", "half")]):
                found = set(hits_of(t, matcher, known))
                rows += [(*h, int(y), half) for h in found] or [("", 0, "", "", int(y), half)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["term", "distance", "context", "word", "y", "half"])
        give_back()

    halves = texts.withColumn("half", F.pmod(F.xxhash64("t"), F.lit(2)).cast("int")).repartition("d")
    hits = halves.mapInArrow(run, "term string, distance int, context string, word string, y int, half int")
    rows = hits.groupBy("term", "distance", "context", "word", "y", "half").count().collect()  # bounded by the sample
    clean_words = [{r["word"] for r in rows if r["y"] == 0 and r["distance"] > 0 and r["half"] == k and r["context"][0] != "q"} for k in (0, 1)]
    exceptions = sorted(clean_words[0] | clean_words[1])
    seen: dict[tuple, list[float]] = {}
    none = [0.5, 0.5]
    for r in rows:
        if not r["term"]:
            none[r["y"]] += r["count"] * weight[r["y"]]
        elif not r["distance"] or r["half"] and r["word"] not in clean_words[0]:
            d = min(r["distance"], 2)
            for key in (("d", d), ("c", d, r["context"]), ("t", r["term"], d), ("x", r["term"], d, r["context"])):
                seen.setdefault(key, [0.0, 0.0])[r["y"]] += r["count"] * weight[r["y"]]
    return {"terms": terms, "stems": stems, "exceptions": exceptions, "seen": seen,
            "empty": none[1] / (none[0] + none[1]) if terms or stems else 0.0}


def hit_chance(model: dict, term: str, distance: int, context: str) -> float:
    """Smoothed share of toxic texts among training texts with such a hit: the
    odds of the term at this distance, times the likelihood ratio of the
    context over all terms, are the prior of the counts of the term in this
    context."""
    d = min(distance, 2)
    (a0, a1), (c0, c1), (t0, t1), (x0, x1) = (
        model["seen"].get(k, (0.0, 0.0)) for k in (("d", d), ("c", d, context), ("t", term, d), ("x", term, d, context)))
    base = (a1 + (0.8, 0.5, 0.2)[d] * 4) / (a0 + a1 + 4)
    # a term never seen in clean texts still has half a clean text, for the ratio to act on
    odds = (t1 + 2 * base) / (t0 + max(2 * (1 - base), 0.5))
    ratio = (c1 + base) / (c0 + 1 - base) * (1 - base) / base
    prior = odds * ratio / (1 + odds * ratio)
    return (x1 + 2 * prior) / (x0 + x1 + 2)


def scored(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``n_hits``, ``n_quoted``."""
    import pyarrow as pa  # noqa: PLC0415

    def make():
        matcher, known = Matcher(model["terms"], model["stems"]), {}
        exceptions = set(model["exceptions"])
        chances: dict[tuple, float] = {}

        def score(texts):
            scores, hits, quoted = [], [], []
            for t in texts:
                found = [h for h in hits_of(t, matcher, known) if not h[1] or h[3] not in exceptions]
                clean = 1.0
                for h in {h[:3] for h in found}:
                    if h not in chances:
                        chances[h] = hit_chance(model, *h)
                    clean *= 1 - chances[h] if chances[h] >= MIN_CHANCE else 1
                scores.append(max(1 - clean, model["empty"]))
                hits.append(len(found))
                quoted.append(sum(h[2][0] == "q" for h in found))
            return scores, hits, quoted

        return score

    fields = [("score", "double", pa.float64()), ("n_hits", "long", pa.int64()), ("n_quoted", "long", pa.int64())]
    return add_columns(docs, [text], fields, make)


def accepted(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The documents scored below ``PREDICTED_FROM``, with their own columns."""
    out = scored(docs.withColumnsRenamed({c: f"_kept_{c}" for c in docs.columns if c in ("score", "n_hits", "n_quoted")}), model, text)
    names = [F.col(f"_kept_{c}").alias(c) if c in ("score", "n_hits", "n_quoted") else F.col(f"`{c}`") for c in docs.columns]
    return out.filter(F.col("score") < PREDICTED_FROM).select(*names)
