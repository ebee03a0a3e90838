"""Prefix trie of conversations by truncation peeling.

Every conversation ends at the node of its whole turn sequence.  Peeling
starts at the greatest depth: conversations that end there are merged with
the nodes that survive from one deeper, each merged group is a finished node,
its last turn is stripped and the shortened sequences are grouped again.  A
node's figures (members, smallest id, children, leaves, saved code points) are
sums and minima of what is merged into it, so they are complete when it is
discovered.

* A turn's identity is a running SHA-256 over the turns so far, cut to
  ``KEY`` bytes; a sequence is carried as its ``path``, ``STEP`` bytes a turn
  (identity and code points of the text), never as its texts.
* Equal conversations are merged first, by a partial aggregate.
* Depths from ``SHALLOW`` down are peeled one at a time, by a DataFrame
  aggregate with a partial step, so a first turn that most conversations share
  costs one row a task.  Deeper ones are peeled in bands (``SHALLOW`` times 1,
  4, 16, ...): all sequences with the same ancestor at the band's upper end
  come to one task in descending order of their paths, and are peeled there
  against the one sequence that is open, a turn at a time.  A band in which
  an ancestor has more than ``CROWD`` sequences is peeled depth by depth too.
* Each band and depth is written to the shared folder, so lost executors cost
  no more than the step that runs.

Results of odd input: null roles and texts count as empty; a null turn comes
first; rows of one conversation with equal turns are ordered by role and text;
repeated rows are repeated turns; rows without a conversation id belong to no
conversation; an empty table gives an empty result; further columns are
ignored.  A path must fit in a task: 40 bytes a turn of its conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc_sql, stored

KEY = 32
STEP = KEY + 8
SHALLOW = 8
CROWD = 200_000
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

#: What a node gathers from what is merged into it, and how.
FIGURES = {"conv_id": "min", "n_convs": "sum", "n_children": "sum", "n_leaves": "sum", "below_saved": "sum"}


def rebuilt(conversations: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, depth, role, text): each conversation c with the first h
    turns of conversation c - c % ``block`` before its own turns after its
    first h, h being the CRC-32 of c as decimal text modulo ``heads``; a
    conversation left without turns is one row of depth 0."""
    rows = conversations.selectExpr(
        "CAST(conv_id AS long) AS conv_id", "turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text").filter("conv_id IS NOT NULL")
    own = rows.selectExpr(
        "conv_id", "row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS depth", "role", "text",
        f"conv_id - conv_id % {block} AS base", f"crc32(CAST(CAST(conv_id AS string) AS binary)) % {heads} AS h")
    ids = rows.groupBy("conv_id").agg(F.lit(0).alias("depth")).selectExpr(
        "conv_id", f"conv_id - conv_id % {block} AS base", f"crc32(CAST(CAST(conv_id AS string) AS binary)) % {heads} AS h")
    first = own.filter(f"depth < {heads} AND conv_id = base").selectExpr("base", "depth", "role", "text")
    # at most `block` conversations share a head of fewer than `heads` turns
    head = ids.join(first, "base").filter("depth <= h").select("conv_id", "depth", "role", "text")
    none = ids.selectExpr("conv_id", "0 AS depth", "'' AS role", "'' AS text")
    return head.unionByName(own.filter("depth > h").select("conv_id", "depth", "role", "text")).unionByName(none)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation of ``turns`` (conv_id, depth,
    role, text), whose turns are taken in order of depth; depth 0 is no turn.

    A task streams its conversations in order and holds one path at a time."""

    def run(batches):
        import hashlib  # noqa: PLC0415

        import pyarrow as pa  # noqa: PLC0415

        conv, path, state = None, bytearray(), b""
        for b in batches:
            ids, out = [], []
            for c, depth, role, text in zip(*[x.to_pylist() for x in b.columns]):
                if c != conv:
                    if conv is not None:
                        ids.append(conv)
                        out.append(bytes(path))
                    conv, path, state = c, bytearray(), b""
                if depth:
                    r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
                    state = hashlib.sha256(b"%s%d:%s%s" % (state, len(r), r, t)).digest()[:KEY]
                    path += state + len(text).to_bytes(8, "big")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["conv_id", "path"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([bytes(path)], pa.binary())], names=["conv_id", "path"])

    dealt = turns.select("conv_id", "depth", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return dealt.mapInArrow(run, "conv_id long, path binary")


def _node(path: str = "path") -> str:
    """SQL of a path's identity: the key of its last turn (root: empty)."""
    return f"substring({path}, -{STEP}, {KEY})"


def _stripped(nodes: DataFrame) -> DataFrame:
    """What finished nodes of one depth pass on to their parents."""
    return nodes.selectExpr(f"substring(path, 1, length(path) - {STEP}) AS path", "conv_id", "n_convs", "1L AS n_children",
                            "n_leaves", "saved_tokens AS below_saved")


def _merged(parts: DataFrame) -> DataFrame:
    """Finished nodes from entries of one depth: one row per path."""
    rows = parts.groupBy("path").agg(*[F.expr(f"{f}({c}) AS {c}") for c, f in FIGURES.items()])
    chars = f"CASE WHEN length(path) = 0 THEN 0L ELSE CAST(conv(hex(substring(path, -8, 8)), 16, 10) AS long) END"
    return rows.selectExpr(
        f"CAST(length(path) / {STEP} AS int) AS depth", "path", "conv_id", "n_convs", "n_children",
        "if(n_children = 0, 1L, n_leaves) AS n_leaves", f"below_saved + (n_convs - 1) * ({chars}) AS saved_tokens")


NODE_SCHEMA = "depth int, path binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _peeled_band(entries: DataFrame, low: int) -> DataFrame:
    """Finished nodes of depth ``low`` and more, from the entries of a band
    (path and figures; ``n_children`` null marks a node that is finished
    already and only has its parent to reach).

    A task sees its paths in descending order, so every sequence comes after
    all that extend it: the open sequence is peeled a turn at a time until
    the next one shares what is left."""

    def run(batches):
        import pyarrow as pa  # noqa: PLC0415

        levels: list[list] = []  # figures of the open path's prefixes of depth low, low + 1, ...
        path = b""

        def strip(out):
            """Finish the open path's deepest node and merge it into its parent."""
            nonlocal path
            conv, n, children, leaves, below, done = levels.pop()
            saved = below
            if not done:
                leaves = leaves if children else 1
                saved = below + (n - 1) * int.from_bytes(path[-8:], "big")
                out.append((len(path) // STEP, path, conv, n, children, leaves, saved))
            if levels:
                up = levels[-1]
                up[0] = conv if up[0] is None or conv < up[0] else up[0]
                up[1] += n
                up[2] += 1
                up[3] += leaves
                up[4] += saved
            path = path[:-STEP]

        def batch(out):
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)

        names = ["depth", "path", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        arrow = pa.schema([("depth", pa.int32()), ("path", pa.binary()), *[(c, pa.int64()) for c in names[2:]]])
        for b in batches:
            out: list = []
            for x, conv, n, children, leaves, below in zip(*[c.to_pylist() for c in b.columns]):
                while levels and not x.startswith(path):
                    strip(out)
                if not levels:
                    path = x[:low * STEP]
                    levels.append([None, 0, 0, 0, 0, False])
                while len(path) < len(x):
                    path = x[:len(path) + STEP]
                    levels.append([None, 0, 0, 0, 0, False])
                top = levels[-1]
                top[0] = conv if top[0] is None or conv < top[0] else top[0]
                top[1] += n
                if children is None:
                    top[3], top[4], top[5] = leaves, below, True
                if len(out) >= 4096:
                    yield batch(out)
                    out = []
            yield batch(out)
        out = []
        while levels:
            strip(out)
        yield batch(out)

    dealt = entries.selectExpr(f"substring(path, 1, {low * STEP}) AS ancestor", "*").repartition("ancestor")
    dealt = dealt.sortWithinPartitions(F.desc("path"), F.expr("n_children IS NULL"))
    return dealt.select("path", *FIGURES).mapInArrow(run, NODE_SCHEMA)


def bands(deepest: int, shallow: int = SHALLOW) -> list[int]:
    """Upper ends of the bands, deepest first."""
    ends = []
    low = shallow
    while low <= deepest:
        ends.append(low)
        low *= 4
    return ends[::-1]


def peeled(ends: DataFrame, shallow: int = SHALLOW, crowd: int = CROWD) -> DataFrame:
    """All nodes of the trie of ``ends`` (conv_id, path): node, parent (null:
    root), depth and the figures."""
    spark = ends.sparkSession
    merged = ends.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    merged = stored(merged.selectExpr(f"CAST(length(path) / {STEP} AS int) AS depth", "path", "conv_id", "n_convs",
                                      "0L AS n_children", "0L AS n_leaves", "0L AS below_saved"), "trie-ends")
    deepest = merged.agg(F.max("depth")).first()[0]
    done: list[DataFrame] = []
    if deepest is None:
        return _keyed(spark.createDataFrame([], NODE_SCHEMA))
    alive = None  # finished nodes of the depth peeled last
    high = deepest + 1

    def one_by_one(high, low, alive):
        for d in range(high - 1, low - 1, -1):
            parts = merged.filter(f"depth = {d}").drop("depth")
            parts = parts.unionByName(_stripped(alive)) if alive is not None else parts
            alive = stored(_merged(parts), f"trie-depth-{d}")
            done.append(alive)
        return alive

    for low in bands(deepest, shallow):
        parts = merged.filter(f"depth >= {low} AND depth < {high}").drop("depth")
        if alive is not None:
            parts = parts.unionByName(alive.selectExpr("path", "conv_id", "n_convs", "CAST(NULL AS long) AS n_children",
                                                       "n_leaves", "saved_tokens AS below_saved"))
        crowds = parts.groupBy(F.expr(f"substring(path, 1, {low * STEP})")).count().agg(F.max("count")).first()[0] or 0
        if crowds > crowd:
            alive = one_by_one(high, low, alive)
        else:
            band = stored(_peeled_band(parts, low), f"trie-band-{low}")
            done.append(band)
            alive = band.filter(f"depth = {low}")
        high = low
    one_by_one(high, 0, alive)
    nodes = done[0]
    for d in done[1:]:
        nodes = nodes.unionByName(d)
    return _keyed(nodes)


def _keyed(nodes: DataFrame) -> DataFrame:
    parent = f"CASE WHEN depth > 0 THEN substring(path, length(path) - {2 * STEP - 1}, {KEY}) END"
    return nodes.selectExpr(f"{_node()} AS node", f"CASE WHEN depth = 1 THEN CAST('' AS binary) ELSE {parent} END AS parent",
                            "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def trie(turns: DataFrame, shallow: int = SHALLOW, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of conversations (conv_id, depth, role, text): the trie's
    nodes with ``parent_conv_id``, and (conv_id, node) where each conversation
    ends."""
    ends = stored(paths(turns), "trie-paths")
    nodes = stored(peeled(ends, shallow, crowd), "trie-nodes")
    root = nodes.filter("depth = 0").select("conv_id").first()
    # first turns have one known parent; the others meet theirs by key
    up = nodes.filter("depth > 0").selectExpr("node AS parent", "conv_id AS parent_conv_id")
    deep = nodes.filter("depth > 1").join(up, "parent")
    top = nodes.filter("depth <= 1").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(root[0] if root else None).cast("long")))
    cols = ["node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return deep.select(*cols).unionByName(top.select(*cols)), ends.selectExpr("conv_id", f"{_node()} AS node")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end: the SHA-256 of
    their ids in ascending order, joined by commas.

    The ids of a node stream through one task in order, of which only the
    running digest is held."""

    def run(batches):
        import hashlib  # noqa: PLC0415

        import pyarrow as pa  # noqa: PLC0415

        node, digest = None, None
        for b in batches:
            nodes, out = [], []
            for x, c in zip(*[col.to_pylist() for col in b.columns]):
                if x != node:
                    if digest is not None:
                        nodes.append(node)
                        out.append(digest.hexdigest())
                    node, digest = x, hashlib.sha256(b"%d" % c)
                else:
                    digest.update(b",%d" % c)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.string())], names=["node", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    dealt = ends.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    return dealt.mapInArrow(run, "node binary, ends_sha256 string")


def digest(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """One row per node with the digest of the ids that end there."""
    found = nodes.join(ends_digests(ends), "node", "left")
    return found.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


#: ``op11`` in DuckDB SQL over ``conversations``: every prefix as a list of its turns.
SQL = f"""
WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
 b AS (SELECT o.conv_id, o.turns, h.turns AS head FROM o LEFT JOIN o h ON h.conv_id = o.conv_id - o.conv_id % 100),
 {CRC_TABLE_SQL},
 h AS (SELECT conv_id, turns, head, {crc_sql("conv_id::VARCHAR")} % 6 AS h FROM b, poly),
 p AS (SELECT conv_id, list_concat(COALESCE(list_slice(head, 1, h), []), list_slice(turns, h + 1, len(turns))) AS path FROM h),
 m AS (SELECT conv_id, path, d FROM p, range(0, 100000) r(d) WHERE d <= len(path)),
 n AS (SELECT list_slice(path, 1, d) AS node, d AS depth, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs,
        string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(path) = d) AS ends FROM m GROUP BY ALL),
 k AS (SELECT list_slice(node, 1, depth - 1) AS node, COUNT(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
 a AS (SELECT n.*, COALESCE(n_children, 0) AS n_children,
        CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(node[depth].t) END AS saved FROM n LEFT JOIN k USING (node)),
 s AS (SELECT list_slice(node, 1, d) AS node, SUM(saved)::BIGINT AS saved_tokens, COUNT(*) FILTER (WHERE n_children = 0) AS n_leaves
       FROM a, range(0, 100000) r(d) WHERE d <= depth GROUP BY ALL)
SELECT a.conv_id, a.depth, u.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens,
 sha256(COALESCE(a.ends, '')) AS ends_sha256
FROM a JOIN s USING (node) LEFT JOIN n u ON a.depth > 0 AND u.node = list_slice(a.node, 1, a.depth - 1)
"""
