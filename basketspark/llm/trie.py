"""Conversation prefix tries: what conversations have in common from their first turn on.

A node is a sequence of turns (role, text) that some conversation begins with. It is known by
a chained hash: each prefix's SHA-256 (16 bytes) is that of its parent's and of its last
turn's digest, so a prefix is hashed once however long it is.

Tasks read conversations sorted, turn after turn, and keep a small table of the nodes they
meet; these partial tries are merged by node in rounds (a node has a row for each partial
trie at first, for each ``FAN`` of these after a round), in which members add up and lists of
the conversations that end there are joined. The roll-up doubles distances: in round k each
node passes what its descendants nearer than 2^k have on to the ancestor 2^k above it, which
it knows from the time it was met; so a trie of depth d takes log2(d) rounds, not d. Nodes of
one conversation only are a path to a leaf and need no roll-up.

Lists of ends are kept in cells of 4096 neighbouring ids, so none grows with a group of
copies; the digest over a node's list reads its cells in order, one at a time. Nodes with very
many children are joined with them by broadcast, of which there can be no more than 1024.

Defined results: null roles and texts are empty; null turns come first; turns of equal number
are ordered by role and text, repeated ones are all kept; rows without a conversation id are
in no conversation; an empty table has no nodes, not even a root; turns may be of any length
and conversations have any number of turns, as they are streamed; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: How many partial tries meet in one row of a round.
FAN = 32
#: Ids of a cell of a list of ends: 2^CELL neighbouring ones.
CELL = 12
#: Entries of a task's partial trie before it is passed on.
ENTRIES = 50_000
ROOT = b"\0" * 16

NODES = "slot int, node binary, parent binary, depth int, chars long, conv_id long, n_convs long, up array<binary>, cell long, ids array<long>"
_ARROW = pa.schema([
    ("slot", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("chars", pa.int64()), ("conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("up", pa.list_(pa.binary())), ("cell", pa.int64()), ("ids", pa.list_(pa.int64())),
])


class _Partial:
    """A table of nodes and of the conversations that end at them."""

    def __init__(self, slot: int):
        self.slot, self.nodes, self.ends = slot, {}, {}

    def add(self, conv: int, path: list[bytes], chars: list[int]) -> None:
        """A conversation that passes through the nodes of ``path``, the root first."""
        nodes = self.nodes
        for d, node in enumerate(path):
            if (have := nodes.get(node)) is None:
                up, k = [], 1
                while k <= d:
                    up.append(path[d - k])
                    k *= 2
                nodes[node] = [path[d - 1] if d else None, d, chars[d], conv, 1, up]
            else:
                have[4] += 1
                if conv < have[3]:
                    have[3] = conv
        self.ends.setdefault((path[-1], conv >> CELL), []).append(conv)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for items, made in ((self.nodes, self._node), (self.ends, self._end)):
            columns = list(zip(*(made(k, v) for k, v in items.items()), strict=True))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)
        self.nodes, self.ends = {}, {}

    def _node(self, node: bytes, v: list) -> tuple:
        return self.slot, node, *v, None, None

    def _end(self, key: tuple[bytes, int], ids: list[int]) -> tuple:
        return self.slot, key[0], None, None, None, None, None, None, key[1], sorted(ids)


def _partial_tries(first_turns: int):
    """A function for batches of (base, conv_id, turns to take from the base, digest, chars), sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = _Partial(TaskContext.get().partitionId())
        base, lead = None, []  # the base conversation's first turns
        conv, h, seen, path, chars = None, 0, 0, [], []

        def begin() -> None:
            nonlocal seen, path, chars
            path, chars, seen = [ROOT], [0], 0
            if conv != base:
                for digest, n in lead[:h]:
                    follow(digest, n)

        def follow(digest: bytes, n: int) -> None:
            path.append(hashlib.sha256(path[-1] + digest).digest()[:16])
            chars.append(n)

        for t in batches:
            for b, c, take, digest, n in zip(*(t.column(i).to_pylist() for i in range(5)), strict=True):
                if c != conv:
                    if conv is not None:
                        part.add(conv, path, chars)
                        if len(part.nodes) + len(part.ends) > ENTRIES:
                            yield from part.rows()
                    if b != base:
                        base, lead = b, []
                    conv, h = c, take
                    begin()
                seen += 1
                if conv == base:
                    if len(lead) < first_turns:
                        lead.append((digest, n))
                    follow(digest, n)
                elif seen > h:
                    follow(digest, n)
        if conv is not None:
            part.add(conv, path, chars)
        yield from part.rows()

    return run


def _ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, digest) of sorted cells (node, ids): one running hash, whatever a node's list is long."""
    node, sha = None, None
    for t in batches:
        out = []
        for k, ids in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
            text = ",".join(map(str, ids)).encode()
            if k == node:
                sha.update(b",")
            else:
                if node is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = k, hashlib.sha256()
            sha.update(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], ["e_node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["e_node", "ends_sha256"])


def rebuilt_tries(turns: DataFrame, every: int, first_turns: int) -> DataFrame:
    """Partial tries of conversations (conv_id, turn, role, text), as rows of ``NODES``.

    A conversation c begins with the first h turns of the conversation c - c % ``every``, h
    being the CRC-32 of its number modulo ``first_turns`` + 1, and goes on with its own turns
    after its first h. These of one base come to one task, sorted, the base first.
    """
    c = F.col("conv_id")
    own = turns.select(
        (c - c % every).alias("base"), c.cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    dealt = own.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "text")
    words = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = dealt.select(
        F.col("base").cast("long"), "conv_id", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(first_turns + 1)).cast("int").alias("h"),
        F.unhex(F.sha2(words, 256)).alias("digest"), F.length("text").cast("long").alias("chars"),
    )
    return rows.mapInArrow(_partial_tries(first_turns), NODES)


def _once_merged(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy("node", "cell", *key).agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.first("up").alias("up"), F.array_sort(F.flatten(F.collect_list(F.coalesce("ids", F.array().cast("array<bigint>"))))).alias("ids"),
    )


def merged(partial: DataFrame) -> DataFrame:
    """One row for each node, and one for each cell of its list of ends (where cell isn't null)."""
    slots = (partial.agg(F.max("slot")).first()[0] or 0) + 1
    while slots > FAN:
        slots = -(-slots // FAN)
        partial = materialize(_once_merged(partial.withColumn("slot", (F.col("slot") / FAN).cast("int")), "slot"), "tries")
    return _once_merged(partial)


def prefix_trie(turns: DataFrame, *, every: int = 100, first_turns: int = 5) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; a row for each node."""
    table = materialize(merged(materialize(rebuilt_tries(turns, every, first_turns), "tries")), "trie")
    nodes = table.filter("cell IS NULL")
    cells = table.filter("cell IS NOT NULL").select("node", "cell", "ids").repartition("node").sortWithinPartitions("node", "cell").select("node", "ids")
    ends = cells.mapInArrow(_ends_digest, "e_node binary, ends_sha256 string")

    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("c_node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("stubs"))
    nodes = nodes.join(children, F.col("node") == F.col("c_node"), "left").drop("c_node").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "stubs": F.coalesce("stubs", F.lit(0))})
    nodes = materialize(nodes.drop("cell", "ids"), "nodes")

    # what each shared node has of its own: leaves that are it or hang on it alone, and the words it saves
    alone = F.col("n_convs") == 1
    sums = nodes.filter(~alone).select("node", "depth", "up", F.when(F.col("n_children") == 0, 1).otherwise(F.col("stubs")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    deepest = sums.agg(F.max("depth")).first()[0] or 0
    k = 0
    while 2**k <= deepest:
        passed = sums.filter(F.col("depth") >= 2**k).groupBy(F.get("up", F.lit(k)).alias("p_node")).agg(F.sum("leaves").alias("p_leaves"), F.sum("saved").alias("p_saved"))
        sums = sums.join(passed, F.col("node") == F.col("p_node"), "left")
        sums = materialize(sums.select("node", "depth", "up", (F.col("leaves") + F.coalesce("p_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("p_saved", F.lit(0))).alias("saved")), "sums")
        k += 1

    named = nodes.select(F.col("node").alias("p_node"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    least = nodes.count() // 1024 + 1
    crowded, others = F.broadcast(named.filter(F.col("n_children") >= least).drop("n_children")), named.filter((F.col("n_children") > 0) & (F.col("n_children") < least)).drop("n_children")
    out = nodes.join(crowded.withColumnsRenamed({"p_node": "q_node", "parent_conv_id": "q_conv_id"}), F.col("parent") == F.col("q_node"), "left")
    known = out.filter("q_node IS NOT NULL OR parent IS NULL").withColumn("parent_conv_id", F.col("q_conv_id"))
    found = out.filter("q_node IS NULL AND parent IS NOT NULL").join(others, F.col("parent") == F.col("p_node")).drop("p_node")
    out = known.unionByName(found)
    out = out.join(sums.select(F.col("node").alias("s_node"), "leaves", "saved"), F.col("node") == F.col("s_node"), "left").join(ends, F.col("node") == F.col("e_node"), "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


TRIE_SQL = """
WITH own AS (
    SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
    FROM conversations WHERE conv_id IS NOT NULL
), crcs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, 
        list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
            lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, byte)), 4294967295::BIGINT) AS crc FROM (SELECT DISTINCT conv_id FROM own)
), convs AS (
    SELECT conv_id, base, xor(crc, 4294967295) % 6 AS h FROM crcs
), built AS (
    SELECT c.conv_id, 0 AS part, o.nth, o.digest, o.chars FROM convs c JOIN own o ON o.conv_id = c.base AND o.nth <= c.h
    UNION ALL SELECT c.conv_id, 1, o.nth, o.digest, o.chars FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.nth > c.h
), paths AS (
    SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, chars FROM built
    WINDOW w AS (PARTITION BY conv_id ORDER BY part, nth ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), nodes AS (
    SELECT path, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY path
), ends AS (
    SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, max_by(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path
), children AS (
    SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
    SELECT left(n.path, 64 * d) AS path, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
    FROM nodes n LEFT JOIN children c USING (path), unnest(range(0, n.depth + 1)) AS r(d) GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
    b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 64)
    LEFT JOIN children c ON c.path = n.path LEFT JOIN ends e ON e.path = n.path JOIN below b ON b.path = n.path
"""
