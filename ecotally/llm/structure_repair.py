"""Conversation structure repair by big-integer weights.

A conversation's role initials are to read ``(s?(ua)+)?``.  Its turns are kept
(cost 0), given the role that fits (2) or deleted (3), and empty turns are
inserted (2); blank and repeated turns must go, a truncated one that stays
costs 1 more.  Of the cheapest edits those whose letters (``D I K R``, in
order) are ASCII-least are taken.

The DAG has four nodes a turn: nothing kept yet, after a leading ``s``, after
``u``, after ``a``.  An edge stands for the insertions before a turn (two at
most: a third would return to a node at a higher cost) and for what happens to
the turn.  Its weight is one integer: the cost in the high digits and the
letters below, in the turn's own slot of ``SLOT`` digits of base 8, zeros at
its end.  The letters of a slot end with the one that is not an insertion, so
no slot's letters begin another's, and comparing slots digit by digit is
comparing the whole audits; the insertions after the last turn are a slot of
their own, where zeros make the shorter audit the lesser.  The least sum of
weights therefore is the cheapest cost with its least audit, and a plain
integer minimum decides everything.

Integers stay bounded: after ``BLOCK`` turns the letters so far are replaced
by their rank among the four nodes, which keeps every later comparison.  A
task streams its conversations in order and holds one at a time: a few bytes a
turn, and the turns themselves, beyond ``SPOOL`` bytes in an unnamed temporary
file of the task.

Results of odd input: null roles and texts count as one space; a null turn
comes first; rows of one conversation with equal turns are ordered by role and
text; a role of other initials is never kept; rows without a conversation id
form one conversation; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, SPACE_CHARS, crc_sql

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
SLOT, BITS = 3, 3
BLOCK = 64
SPOOL = 32 << 20

NOTHING, S, U, A = range(4)
#: Where a kept role initial leads, and where a turn whose role can be chosen does.
KEPT = {(NOTHING, "s"): S, (NOTHING, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
CHOSEN = {NOTHING: U, S: U, U: A, A: U}
ROLE = {U: "user", A: "assistant"}

FAULTS = ("", "blank", "duplicate", "truncated")
ROWS = "conv_id long, place long, turn long, fault string, illegal boolean, edit string, role string, text string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage that their CRC-32 deals them: ``dropped`` rows are
    marked, so that no conversation is lost."""
    rows = conversations.selectExpr("CAST(conv_id AS long) AS conv_id", "CAST(turn AS long) AS turn", "coalesce(role, ' ') AS role",
                                    "coalesce(text, ' ') AS text")
    key = "concat(coalesce(CAST(conv_id AS string), ' '), ':', coalesce(CAST(turn AS string), ' '))"
    rows = rows.selectExpr("*", f"CAST(crc32(CAST({key} AS binary)) % 20 AS int) AS k")
    return rows.selectExpr(
        "conv_id", "turn", "if(k = 4, 'user', role) AS role",
        "CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text", "k = 0 AS dropped",
        "explode(if(k = 3, array(0, 1), array(0))) AS copy").drop("copy")


def edges(initial: str, fault: str) -> list[tuple[int, int, int, int, str]]:
    """(from, to, cost, digits, letters) of the edges of a turn, the least for
    each pair of nodes."""
    best: dict = {}
    extra = TRUNCATED if fault == "truncated" else 0
    for start in range(4):
        node, letters, cost = start, "", 0
        for _ in range(SLOT):
            moves = [(node, "D", DELETE)]
            if fault not in ("blank", "duplicate"):
                moves.append((CHOSEN[node], "R", REROLE + extra))
                if (node, initial) in KEPT:
                    moves.append((KEPT[node, initial], "K", extra))
            for to, letter, c in moves:
                x = letters + letter
                digits = sum(LETTERS[y] << BITS * (SLOT - 1 - k) for k, y in enumerate(x))
                best[start, to] = min(best.get((start, to), (1 << 60,)), (cost + c, digits, x))
            node, letters, cost = CHOSEN[node], letters + "I", cost + INSERT
    return [(a, b, *e) for (a, b), e in sorted(best.items())]


class Solver:
    """Cheapest edits of one conversation's turns, given one by one."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.width = 2 + SLOT * BITS * (block + 1)  # rank, the slots of a block, the slot after the last turn
        self.mask = (1 << self.width) - 1
        self.kinds: dict = {}  # edges by (initial, fault), numbered
        self.names: dict = {}  # (node before, letters) of an edge, numbered
        self.clear()

    def clear(self) -> None:
        self.value: list = [0, None, None, None]
        self.slot = 0
        self.trail = bytearray()  # for each turn and node the number of the edge that reached it

    def _edges(self, initial: str, fault: str):
        key = (initial if initial in ("s", "u", "a") else "", fault)
        if key not in self.kinds:
            self.kinds[key] = [(a, b, c << self.width, digits, self.names.setdefault((a, x), len(self.names)))
                               for a, b, c, digits, x in edges(*key)]
            self.by_number = list(self.names)
        return self.kinds[key]

    def add(self, initial: str, fault: str) -> None:
        if self.slot == self.block:  # the letters so far become ranks
            order = sorted((v & self.mask, k) for k, v in enumerate(self.value) if v is not None)
            for rank, (_, k) in enumerate(order):
                self.value[k] = (self.value[k] >> self.width << self.width) | rank << (self.width - 2)
            self.slot = 0
        shift = SLOT * BITS * (self.block - self.slot)
        value, new, by = self.value, [None] * 4, [0] * 4
        for a, b, cost, digits, number in self._edges(initial, fault):
            if value[a] is not None:
                v = value[a] + cost + (digits << shift)
                if new[b] is None or v < new[b]:
                    new[b], by[b] = v, number
        self.value = new
        self.trail += bytes(by)
        self.slot += 1

    def solve(self) -> list[str]:
        """Letters of each turn's slot, and of the slot after the last."""
        found = []
        for node, v in enumerate(self.value):
            now = node
            for n in range(SLOT if v is not None else 0):
                if now in (NOTHING, A):
                    found.append((v, n, node))
                v += (INSERT << self.width) + (LETTERS["I"] << BITS * (SLOT - 1 - n))
                now = CHOSEN[now]
        _, n, node = min(found)
        out = ["I" * n]
        for k in range(len(self.trail) - 4, -1, -4):
            node, letters = self.by_number[self.trail[k + node]]
            out.append(letters)
        return out[::-1]


class Held:
    """The turns of the conversation that is open: in memory up to ``spool``
    bytes, beyond that in an unnamed temporary file."""

    def __init__(self, spool: int = SPOOL):
        self.spool, self.rows, self.size, self.file = spool, [], 0, None

    def add(self, row: tuple, size: int) -> None:
        import marshal  # noqa: PLC0415
        import tempfile  # noqa: PLC0415

        self.rows.append(row)
        self.size += size + 100
        if self.size > self.spool:
            self.file = self.file or tempfile.TemporaryFile()
            marshal.dump(self.rows, self.file)
            self.rows, self.size = [], 0

    def __iter__(self):
        import marshal  # noqa: PLC0415

        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from marshal.load(self.file)
        yield from self.rows


def repaired(rows: DataFrame, block: int = BLOCK, spool: int = SPOOL) -> DataFrame:
    """Every turn of ``rows`` (conv_id, turn, role, text, dropped) and every
    inserted one, in order of ``place`` within a conversation: its first
    ``fault``, whether its pair with the turn before is ``illegal``, its
    ``edit``, and the role and text that it then has.  A conversation of
    dropped rows only is one row without an edit."""

    def run(batches):
        import hashlib  # noqa: PLC0415

        import pyarrow as pa  # noqa: PLC0415

        arrow = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("fault", pa.string()),
                           ("illegal", pa.bool_()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        solver, nobody = Solver(block), object()
        conv, held, seen, before, size, out = nobody, Held(spool), set(), "", 0, [[] for _ in arrow]

        def full():
            nonlocal out, size
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)
            out, size = [[] for _ in arrow], 0
            return batch

        def emit(*row):
            nonlocal size
            for column, x in zip(out, row):
                column.append(x)
            size += len(row[-1]) + 100

        def close():
            """The edits of the conversation that ends; yields full batches."""
            if not solver.trail:
                emit(conv, 0, None, "", False, None, "", "")
                return
            letters, node, place = solver.solve(), NOTHING, 0
            for k, row in enumerate(held):
                turn, fault, illegal, role, text = row
                for x in letters[k][:-1]:
                    node = CHOSEN[node]
                    emit(conv, place, None, "", False, x, ROLE[node], "")
                    place += 1
                x = letters[k][-1]
                if x == "K":
                    node = KEPT[node, role[:1]]
                elif x == "R":
                    node = CHOSEN[node]
                    role = ROLE[node]
                emit(conv, place, turn, fault, illegal, x, role, text)
                place += 1
                if size > 4 << 20:
                    yield full()
            for x in letters[-1]:
                node = CHOSEN[node]
                emit(conv, place, None, "", False, x, ROLE[node], "")
                place += 1

        for b in batches:
            for c, turn, role, text, dropped in zip(*[x.to_pylist() for x in b.columns]):
                if c != conv:
                    if conv is not nobody:
                        yield from close()
                    conv, held, seen, before = c, Held(spool), set(), ""
                    solver.clear()
                if dropped:
                    continue
                bare = text.strip(SPACE_CHARS)
                r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
                key = hashlib.blake2b(b"%d:%s%s" % (len(r), r, t), digest_size=16).digest()
                fault = "blank" if not bare else "duplicate" if key in seen else "truncated" if bare[-1] not in ".!?" else ""
                seen.add(key)
                initial = role[:1]
                illegal = bool(solver.trail) and before + initial not in ("su", "ua", "au")
                before = initial
                solver.add(initial, fault)
                held.add((turn, fault, illegal, role, text), len(r) + len(t))
            if size > 1 << 20:
                yield full()
        if conv is not nobody:
            yield from close()
        yield full()

    dealt = rows.select("conv_id", "turn", "role", "text", "dropped").repartition("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(run, ROWS)


def digest(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired``'s result, which it streams in
    the order it has."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches):
        import hashlib  # noqa: PLC0415

        import pyarrow as pa  # noqa: PLC0415

        arrow = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        nobody = object()
        conv, n, audit, sha, first, last, distinct, some = nobody, None, None, None, None, None, 0, False

        def close():
            n["gaps"] = last - first + 1 - distinct if distinct else 0
            return [conv, *[n[c] for c in counts], "".join(audit), sha.hexdigest()]

        for b in batches:
            out = []
            for c, turn, fault, illegal, edit, role, text in zip(*[x.to_pylist() for x in b.columns]):
                if c != conv:
                    if conv is not nobody:
                        out.append(close())
                    conv, n, audit, sha = c, dict.fromkeys(counts, 0), [], hashlib.sha256()
                    first, last, distinct, some = None, None, 0, False
                if edit is None:
                    continue
                audit.append(edit)
                n["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                n["illegal"] += illegal
                if fault:
                    n[fault] += 1
                    n["cost"] += TRUNCATED if fault == "truncated" and edit != "D" else 0
                if turn is not None and turn != last:
                    first, last, distinct = turn if first is None else first, turn, distinct + 1
                if edit != "D":
                    sha.update((("\n" if some else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                    some = True
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)
        if conv is not nobody:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(close(), arrow)], schema=arrow)

    return turns.select("conv_id", "turn", "fault", "illegal", "edit", "role", "text").mapInArrow(
        run, "conv_id long, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string")


def _sql() -> str:
    """``op12`` in DuckDB SQL: the same DAG with plain texts, turn after turn;
    a node holds the cost in eight digits, then the audit, and the repaired
    text."""
    then = lambda x, cost, letter, text="NULL": (
        f"CASE WHEN {x} IS NOT NULL THEN {{'k': printf('%08d', substr({x}.k, 1, 8)::INT + {cost}) || substr({x}.k, 9) || '{letter}', "
        f"'t': " + (f"{x}.t" if text == "NULL" else f"CASE WHEN length({x}.k) = 8 OR {x}.t IS NULL THEN {text} ELSE {x}.t || chr(10) || {text} END") + "} END")
    least = lambda *xs: f"list_sort(list_filter([{', '.join(xs)}], lambda z: z IS NOT NULL))[1]"
    put = lambda x, to: then(x, INSERT, "I", f"'{ROLE[to]}:'")
    closed = lambda src: f"""c1 AS (SELECT *, {least("q2", put("q0", U), put("q1", U), put("q3", U))} AS c_u FROM {src}),
     c2 AS (SELECT *, {least("q3", put("q2", A), put(f"({put('q0', U)})", A), put(f"({put('q1', U)})", A))} AS c_a FROM c1)"""  # noqa: E731
    keep = lambda x: then(x, "late", "K", "role || ':' || text")
    rerole = lambda x, to: then(x, f"{REROLE} + late", "R", f"'{ROLE[to]}:' || text")
    if_ = lambda test, x: f"CASE WHEN {test} THEN {x} END"
    stays, ini = "NOT must", "substr(role, 1, 1)"
    step = f"""SELECT conv_id, g, i, {then("q0", DELETE, "D")} AS q0,
       {least(then("q1", DELETE, "D"), if_(f"{stays} AND {ini} = 's'", keep("q0")))} AS q1,
       {least(then("c_u", DELETE, "D"), *[if_(f"{stays} AND {ini} = 'u'", keep(x)) for x in ("q0", "q1", "c_a")],
              *[if_(stays, rerole(x, U)) for x in ("q0", "q1", "c_a")])} AS q2,
       {least(then("c_a", DELETE, "D"), if_(f"{stays} AND {ini} = 'a'", keep("c_u")), if_(stays, rerole("c_u", A)))} AS q3"""
    state = "NULL::STRUCT(k VARCHAR, t VARCHAR)"
    return rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
 o AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text FROM conversations),
 k AS (SELECT o.*, {crc_sql("COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' ')")} % 20 AS k FROM o, poly),
 d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
       FROM k, range(2) c(n) WHERE k <> 0 AND (n = 0 OR k = 3)),
 n AS (SELECT *, COALESCE(conv_id::VARCHAR, '-') AS g, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
 f AS (SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, ROW_NUMBER() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
        NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut, LAG(role) OVER (PARTITION BY g ORDER BY i) AS prev FROM n),
 r AS MATERIALIZED (SELECT g, i, role, text, blank OR again AS must, CASE WHEN cut THEN {TRUNCATED} ELSE 0 END AS late, blank,
        again AND NOT blank AS duplicate, cut AND NOT blank AND NOT again AS truncated, turn,
        i > 1 AND substr(prev, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM f),
 w AS (
  SELECT DISTINCT conv_id, COALESCE(conv_id::VARCHAR, '-') AS g, 0::BIGINT AS i, {{'k': '00000000', 't': NULL::VARCHAR}} AS q0, {state} AS q1, {state} AS q2, {state} AS q3 FROM o
  UNION ALL
  {step} FROM (WITH {closed("(SELECT w.conv_id, w.q0, w.q1, w.q2, w.q3, r.* FROM w JOIN r ON r.g = w.g AND r.i = w.i + 1)")} SELECT * FROM c2)),
 e AS (SELECT w.* FROM w LEFT JOIN (SELECT g, MAX(i) AS n FROM r GROUP BY g) l USING (g) WHERE w.i = COALESCE(n, 0)),
 z AS (WITH {closed("e")} SELECT conv_id, g, {least("q0", "c_a")} AS q FROM c2),
 s AS (SELECT g, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (WHERE blank) AS blank,
        COUNT(*) FILTER (WHERE duplicate) AS duplicate, COUNT(*) FILTER (WHERE truncated) AS truncated, COUNT(*) FILTER (WHERE illegal) AS illegal FROM r GROUP BY g)
SELECT conv_id, COALESCE(gaps, 0)::BIGINT AS gaps, COALESCE(blank, 0)::BIGINT AS blank, COALESCE(duplicate, 0)::BIGINT AS duplicate,
 COALESCE(truncated, 0)::BIGINT AS truncated, COALESCE(illegal, 0)::BIGINT AS illegal, substr(q.k, 1, 8)::BIGINT AS cost,
 substr(q.k, 9) AS audit, sha256(COALESCE(q.t, '')) AS repaired_sha256
FROM z LEFT JOIN s USING (g)
"""


#: ``op12`` in DuckDB SQL over ``conversations``.
SQL = _sql()
