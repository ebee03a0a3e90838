"""Token ids in ORC files.

Documents are range-partitioned and sorted by id, encoded with a public
tokenizer and written as ORC: ids in integer run-length encoding, row indexes
every ``ROW_STRIDE`` rows and a Bloom filter on the document id, so readers
take stripes in parallel and skip those that can't hold an id.  Each row also
stores the part that wrote it and its offset there; a document's place in the
whole corpus is that offset plus the ids of all earlier parts, summed over the
few part totals.

Results of odd input: a null or empty text is one end id; rows with equal ids
stay separate, in the order of their texts; an empty table writes no row and
reads back empty; further columns are not written.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, scratch

END_ID = 2
ROW_STRIDE = 1_000
STRIPE_BYTES = 16 << 20
#: Words whose ids a Python worker remembers; full, it starts anew.
REMEMBERED = 250_000
#: Bytes of text whose words are numbered together.
CHUNK_BYTES = 4 << 20
#: ASCII marks that may follow a word's letters; the vocabulary encodes such a run by itself.
MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())

SCHEMA = "{id} {id_type}, part int, offset long, n_tokens long, ids array<int>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers  # noqa: PLC0415

    return str(public_tokenizers.path(name))


#: Preparation of a text for which its words can be encoded one by one (see ``Encoder``).
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Letters with one lower case: A-Z and those of U+00C0 to U+00FF.
LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"


class Encoder:
    """Ids of texts by a public tokenizer, each text followed by ``end_id``.

    Where the tokenizer prepares texts as ``BY_WORDS`` says, it drops white
    space, never joins across it, lower-cases, and encodes letters apart from
    the marks behind them.  The texts of a chunk then are split and their
    words numbered by Arrow, and only distinct words are encoded: letters and
    marks by themselves, many letter runs in one call (each ends in a token
    with a word end), any other word as it is.  Any other tokenizer encodes
    whole texts."""

    def __init__(self, path: str, end_id: int = END_ID):
        import json  # noqa: PLC0415
        import os  # noqa: PLC0415
        import re  # noqa: PLC0415

        import numpy as np  # noqa: PLC0415
        from tokenizers import Tokenizer  # noqa: PLC0415

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        self.tok, self.end_id = Tokenizer.from_file(path), end_id
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.by_words = (all(made.get(k) == v for k, v in BY_WORDS.items()) and made.get("post_processor") is None
                         and made["model"].get("end_of_word_suffix") == "</w>" and not made["model"].get("dropout")
                         and all(re.search(r"\W$", t["content"]) for t in made.get("added_tokens", [])))
        self.ends = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.letters = re.compile(LETTERS).fullmatch
        self.parts: dict[bytes, bytes] = {b"": b""}  # ids of letter runs and marks
        self.odd: dict[bytes, bytes] = {}  # ids of other words

    def _each(self, texts: list[str]) -> list[bytes]:
        import numpy as np  # noqa: PLC0415

        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: list[bytes], marks: list[bytes], odd: list[bytes]) -> None:
        import numpy as np  # noqa: PLC0415

        for lo in range(0, len(runs), 4_000):
            some = runs[lo:lo + 4_000]
            ids = np.array(self.tok.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for x, c in zip(some, (4 * cuts).tolist()):
                    self.parts[x] = raw[at:c]
                    at = c
            else:
                self.parts.update(zip(some, self._each([x.decode() for x in some])))
        self.parts.update(zip(marks, self._each([x.decode() for x in marks])))
        self.odd.update(zip(odd, self._each([x.decode("utf-8", "replace") for x in odd])))

    def _ids_of(self, found: list[bytes]) -> list[bytes | None]:
        """Ids of distinct letter runs and marks, lower-cased; None for what is
        neither."""
        parts = self.parts
        if len(parts) + len(self.odd) > REMEMBERED:
            parts.clear()
            self.odd.clear()
            parts[b""] = b""
        get = parts.get
        ids = [get(x) for x in found]
        runs, marks, where = {}, [], []
        for k, x in enumerate(found):
            if ids[k] is None:
                if self.letters(x):
                    runs[x if x.isascii() else x.decode().lower().encode()] = None
                    where.append(k)
                elif not x.strip(MARKS):
                    marks.append(x)
                    where.append(k)
        self._learn([x for x in runs if x not in parts], marks, [])
        for k in where:
            x = found[k]
            if x not in parts:
                parts[x] = parts[x.decode().lower().encode()]
            ids[k] = parts[x]
        return ids

    def _of_words(self, words):
        """(pool, numbers): ids of distinct words, an Arrow array; word k has
        the lists numbered 2k and 2k + 1, of its letters and the marks behind."""
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415
        import pyarrow.compute as pc  # noqa: PLC0415

        n = len(words)
        lower = pc.ascii_lower(words)
        bare = pc.ascii_rtrim(lower, characters=MARKS.decode())
        _, at, data = pa.concat_arrays([lower]).buffers()
        starts = np.frombuffer(at, np.int64, n + 1)
        cuts = np.empty(2 * n + 1, np.int64)
        cuts[0::2] = starts
        cuts[1::2] = starts[:-1] + pc.binary_length(bare).to_numpy()
        split = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n, [None, pa.py_buffer(cuts), data]).dictionary_encode()
        ids, numbers = self._ids_of(split.dictionary.to_pylist()), split.indices.to_numpy()
        none = np.fromiter((x is None for x in ids), bool, len(ids))
        if none.any():  # other words are encoded as they are
            numbers = numbers.copy()
            at = np.flatnonzero(none[numbers[0::2]])
            raw = [x.encode("utf-8", "surrogatepass") for x in words.take(pa.array(at)).to_pylist()]
            self._learn([], [], [x for x in raw if x not in self.odd])
            numbers[2 * at] = len(ids) + np.arange(len(at))
            numbers[2 * at + 1] = len(ids) + len(at)
            ids += [*[self.odd[x] for x in raw], b""]
        sizes = np.fromiter((len(x or b"") for x in ids), np.int64, len(ids)) // 4
        pool = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join([x or b"" for x in ids]), "<u4"))
        return pool, numbers, sizes

    def encode(self, texts):
        """(ids, offsets) of an Arrow array of texts (null: empty)."""
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415
        import pyarrow.compute as pc  # noqa: PLC0415

        if self.by_words:
            lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
            words = lists.values.dictionary_encode()
            pool, numbers, sizes = self._of_words(words.dictionary)
            pool = pa.LargeListArray.from_arrays(  # a list for each word
                np.concatenate([[0], np.cumsum(sizes[numbers])])[0::2], pool.take(pa.array(numbers)).flatten())
            sizes = np.diff(pool.offsets.to_numpy())
            ids = pool.take(words.indices).flatten().to_numpy()
            word_ends = np.concatenate([[0], np.cumsum(sizes[words.indices.to_numpy()])])
            offsets = word_ends[lists.offsets.to_numpy()]
        else:
            each = self._each([t or "" for t in texts.to_pylist()])
            ids = np.frombuffer(b"".join(each), "<u4")
            offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) // 4)])
        return np.insert(ids, offsets[1:], np.uint32(self.end_id)), offsets + np.arange(len(offsets))


def encoder(path: str | None = None, end_id: int = END_ID) -> Encoder:
    """The worker's ``Encoder`` of a tokenizer: a Python worker that Spark uses
    again keeps what it has learned, in a module of its own."""
    import sys  # noqa: PLC0415
    import types  # noqa: PLC0415

    path = path or tokenizer_path()
    kept = sys.modules.setdefault("ecotally_worker", types.ModuleType("ecotally_worker", "What a Python worker keeps between tasks."))
    found = vars(kept).setdefault("encoders", {})
    if path not in found:
        found[path] = Encoder(path, end_id)
    found[path].end_id = end_id
    return found[path]


def in_chunks(batch, column: int, size: int = CHUNK_BYTES):
    """Slices of an Arrow batch of about ``size`` bytes in a text column; a
    longer text is a slice by itself."""
    import numpy as np  # noqa: PLC0415
    import pyarrow as pa  # noqa: PLC0415
    import pyarrow.compute as pc  # noqa: PLC0415

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()).to_numpy()
    group = np.cumsum(sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                 order_by: list | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write them to ``path`` in ascending order of
    ``order_by`` (default: the document id)."""
    keys = order_by or [F.col(doc_id)]
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"),
                       *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    names = [f"_k{i}" for i in range(len(keys))]
    # equal ids stay in one part; a key that a third of all rows share is split by its text
    rows = rows.repartitionByRange(*names, F.xxhash64("_text")).sortWithinPartitions(*names, F.xxhash64("_text"), "_text")

    def run(batches):
        import numpy as np  # noqa: PLC0415
        import pyarrow as pa  # noqa: PLC0415
        from pyspark import TaskContext  # noqa: PLC0415

        encode, offset = encoder(tokenizer, end_id).encode, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for b in in_chunks(batch, 1):
                ids, offsets = encode(b.column(1))
                counts = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(offset + offsets[:-1]), pa.array(counts),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4")))],
                    names=[doc_id, "part", "offset", "n_tokens", "ids"])
                offset += int(offsets[-1])
            give_back()

    encoded = rows.select("_id", "_text").mapInArrow(run, SCHEMA.format(id=f"`{doc_id}`", id_type=id_type))
    (encoded.write.option("compression", "zstd").option("orc.stripe.size", STRIPE_BYTES)
     .option("orc.create.index", "true").option("orc.row.index.stride", ROW_STRIDE)
     .option("orc.bloom.filter.columns", doc_id).option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_tokens(spark: SparkSession, path: str, doc_id: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """The written rows with ``start``: ids of all documents before each."""
    rows = spark.read.schema(SCHEMA.format(id=f"`{doc_id}`", id_type=id_type)).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))  # a row for each written part
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).cast("long").alias("base"))
    return rows.join(F.broadcast(bases), "part").select(
        doc_id, (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def digest(tokens: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: place, length and CRC-32 of the ids."""
    id_type = tokens.schema[doc_id].dataType.simpleString()

    def run(batches):
        import pyarrow as pa  # noqa: PLC0415

        for b in batches:
            ids, crc = b.column(3), []
            at = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy()).cast("B")
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                crc.append(zlib.crc32(raw[4 * lo:4 * hi]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())],
                                             names=[doc_id, "start", "n_tokens", "ids_crc32"])
        give_back()

    return tokens.select(doc_id, "start", "n_tokens", "ids").mapInArrow(
        run, f"`{doc_id}` {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", **kw) -> DataFrame:
    """Write, read back and digest."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, path, doc_id, **kw)
    id_type = docs.schema[doc_id].dataType.simpleString()
    return digest(read_tokens(spark, path, doc_id, id_type), doc_id)
