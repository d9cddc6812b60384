"""Prefix trie of conversations by preorder intervals.

A node is a distinct sequence of first turns.  Its identity is its depth and a 128-bit polynomial of its turns' digests,
which a scan over sorted rows carries from turn to turn and from partition to partition, so a conversation of
any length is spread over tasks.  A node's rank is the place of its path in lexicographic order.  A path is written
with one label for each node on it that has fewer members than its parent: all other nodes follow their
parent alone and are ordered by depth, so paths stay short in long conversations.

Every node opens at its path and closes behind all paths that begin with it.  Opening and closing rows are sorted together
by ranges; running sums of nodes, leaves and savings give each node's rank and the end of its subtree, and
differences of the two give the subtree's leaves and savings.

Nulls: rows without a conversation are left out; a null role or text is empty; null turns come first.  Turns of one number
stand in the order of their digests, so repeated rows are turns of their own.  No rows give no nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, drop

#: Odd bases of the two 64-bit polynomials.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Conversations are listed in blocks of so many consecutive ids before their ids are hashed.
BLOCK_BITS = 12
#: Follows every label of a path.
CLOSE = "~"


def turn_rows(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, digest, bytes) of all turns: place from 1 in their conversation, MD5 of role and text, bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return in_conversations(rows, ["turn", "digest"]).select("conv_id", "place", "digest", "bytes")


def in_conversations(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place``, from 1 in the order of a conversation's rows, and ``id1``, ``id2`` and ``up1``, ``up2``: polynomials of its
    digests up to the row and up to the row before.

    Rows are sorted by ranges of conversation and order.  A task numbers its rows; what its first conversation has in the
    tasks before is summed over one row a task and added.
    """
    schema = None

    def number(batches):
        nonlocal schema
        part, at, last, n0, held = TaskContext.get().partitionId(), 0, None, 0, [np.uint64(0)] * 2
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            lanes = digest_lanes(batch.column("digest"))
            place, begin = np.arange(len(conv)), np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
            begin = np.maximum.accumulate(np.where(begin, place, -1))
            n, inner = np.where(begin < 0, n0 + place + 1, place - begin + 1), np.maximum(begin, 0)
            sums = [polynomial(t, place - inner + 1, base, begin, n0, h) for t, base, h in zip(lanes, BASES, held, strict=True)]
            schema = schema or pa.schema([*batch.schema, ("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("q1", pa.int64()), ("q2", pa.int64())])
            yield batch_of(schema, [*batch.columns, np.full(len(conv), part), at + place, n, *(q.view(np.int64) for q in sums)])
            last, n0, held, at = conv[-1], int(n[-1]), [q[-1] for q in sums], at + len(conv)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    table = cut(rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).mapInArrow(number, f"{kind}, part int, at long, n long, q1 long, q2 long"), "turns")
    ends = table.groupBy("part").agg(F.min_by("conv_id", "at").alias("first"), F.max_by(F.struct("conv_id", "n", "q1", "q2"), "at").alias("last"))
    found = carried(ends.collect())  # one row a task
    carry = rows.sparkSession.createDataFrame(found, "part int, conv_id long, n0 long, h1 long, h2 long")
    joined = table.join(F.broadcast(carry), ["part", "conv_id"], "left")  # one row a task
    out = None

    def identify(batches):
        nonlocal out
        for batch in batches:
            local, n0 = (batch.column(c).to_numpy() for c in ("n", "n0"))
            n, columns = local + n0, []
            for t, base, q, h in zip(digest_lanes(batch.column("digest")), BASES, ("q1", "q2"), ("h1", "h2"), strict=True):
                own, before = (batch.column(c).to_numpy().view(np.uint64) for c in (q, h))
                with np.errstate(over="ignore"):
                    whole = before + own * power(base, n0)
                    columns += [whole.view(np.int64), (whole - t * power(base, n)).view(np.int64)]
            keep = [i for i, f in enumerate(batch.schema) if f.name not in HIDDEN]
            out = out or pa.schema([*(batch.schema.field(i) for i in keep), ("place", pa.int64()), *((c, pa.int64()) for c in ("id1", "up1", "id2", "up2"))])
            yield batch_of(out, [*(batch.column(i) for i in keep), n, *columns])

    zero = joined.select(*table.columns, *(F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n0", "h1", "h2")))
    return zero.mapInArrow(identify, f"{kind}, place long, id1 long, up1 long, id2 long, up2 long")


HIDDEN = {"part", "at", "n", "q1", "q2", "n0", "h1", "h2"}


def digest_lanes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """Powers modulo 2^64, by squaring."""
    out, square, rest = np.ones(len(exponents), np.uint64), np.uint64(base), exponents.astype(np.uint64)
    with np.errstate(over="ignore"):
        while rest.any():
            out = np.where(rest & np.uint64(1), out * square, out)
            square, rest = square * square, rest >> np.uint64(1)
    return out


def polynomial(digests: np.ndarray, exponents: np.ndarray, base: int, begin: np.ndarray, n0: int, held: np.uint64) -> np.ndarray:
    """Running sums of digest times power in each conversation; rows with ``begin`` below 0 go on from ``n0`` turns and the sum ``held``."""
    with np.errstate(over="ignore"):
        shift = np.uint64(pow(base, n0, 1 << 64))
        weights = digests * power(base, exponents) * np.where(begin < 0, shift, np.uint64(1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights, dtype=np.uint64)])
        return sums[1:] - np.where(begin < 0, np.uint64(0) - held, sums[np.maximum(begin, 0)])


def carried(ends: list) -> list[tuple]:
    """For each task whose first conversation began before it: (task, conversation, turns and polynomials so far)."""
    out, held = [], None
    for e in sorted(ends, key=lambda e: e.part):
        n0, sums = 0, [0, 0]
        if held and held[0] == e.first:
            n0, sums = held[1], held[2]
            out.append((e.part, e.first, n0, *(int(np.uint64(x).view(np.int64)) for x in sums)))
        n, own = e.last.n, [x % (1 << 64) for x in (e.last.q1, e.last.q2)]
        if e.last.conv_id == e.first:  # the whole task is one conversation
            own = [(h + q * pow(base, n0, 1 << 64)) % (1 << 64) for h, q, base in zip(sums, own, BASES, strict=True)]
            n += n0
        held = (e.last.conv_id, n, own)
    return out


def branched(turns: DataFrame, base: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation behind the first turns of another: (its rows, the conversations with one row each).

    ``base`` names the other conversation and ``shared`` how many of its first turns are taken, at most ``most``; as many of the own
    first turns go.  Only ``most`` turns a conversation are gathered.
    """
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "digest", "bytes")))).alias("head"))
    own = cut(own.select("*", base.alias("base"), shared.cast("int").alias("shared")), "heads")
    bases = own.select(F.col("conv_id").alias("base"), F.col("head").alias("front"))
    ids = own.drop("head").join(bases, "base", "left").select("conv_id", "shared", F.when(F.col("shared") > 0, F.slice(F.coalesce("front", F.array().cast("array<struct<place:bigint,digest:binary,bytes:bigint>>")), 1, F.greatest("shared", F.lit(1)))).otherwise(F.array().cast("array<struct<place:bigint,digest:binary,bytes:bigint>>")).alias("front"))
    front = ids.select("conv_id", F.explode("front").alias("t")).select("conv_id", F.col("t.place").alias("turn"), "t.digest", "t.bytes")
    back = turns.join(ids.select("conv_id", "shared"), "conv_id").filter("place > shared").select("conv_id", (F.col("place") + most).alias("turn"), "digest", "bytes")
    return front.unionByName(back), ids.select("conv_id")


NODE = ["depth", "id1", "id2"]


def prefix_trie(rows: DataFrame, conversations: DataFrame, order: list[str]) -> DataFrame:
    """One row for each node of the trie of ``rows`` (conv_id, order columns, digest, bytes).

    ``conversations`` (conv_id) has every conversation once, those without rows too: they end at the root.  The columns are conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the interval
    ``preorder`` to ``subtree_end`` (exclusive).
    """
    turns = in_conversations(rows, order).withColumnRenamed("place", "depth")
    total, smallest = conversations.agg(F.count("*"), F.min("conv_id")).first()
    nodes = cut(turns.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.max("up1").alias("up1"), F.max("up2").alias("up2")), "nodes")
    # nodes right below the root know their parent; the others find theirs, and each its children, by its identity
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_convs"))
    low = nodes.filter("depth > 1").join(above, ["depth", "up1", "up2"])
    top = nodes.filter("depth = 1").withColumn("parent_conv_id", F.lit(smallest).cast("long")).withColumn("parent_convs", F.lit(total).cast("long"))
    kids = nodes.filter("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("id1"), F.col("up2").alias("id2")).agg(F.count("*").alias("n_children"))
    linked = cut(low.unionByName(top).join(kids, NODE, "left").na.fill(0, ["n_children"]), "linked")
    drop(nodes)
    below_root = linked.filter("depth = 1").count()
    # paths: the labels of all nodes with fewer members than their parent, for conversations that name a node
    heads = linked.filter("n_convs < parent_convs").select(*NODE)
    named = turns.join(linked.select("conv_id").distinct(), "conv_id", "left_semi").join(heads, NODE)
    label = F.concat(*(F.lpad(F.hex(c), 16, "0") for c in NODE[1:]))
    paths = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", label.alias("label")))).alias("path"))
    short = F.transform(F.filter("path", lambda x: x["depth"] <= F.col("depth")), lambda x: x["label"])
    ranked = linked.join(paths, "conv_id", "left").select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "bytes", F.coalesce(F.array_join(short, ""), F.lit("")).alias("path"))
    root = conversations.sparkSession.createDataFrame([(0, 0, 0, smallest, None, total, below_root, 0, "")] if total else [], ranked.schema)
    out = intervals(ranked.unionByName(root))
    drop(linked)
    found = out.join(ends(turns, conversations), NODE, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "preorder", "subtree_end")


def intervals(nodes: DataFrame) -> DataFrame:
    """Opening and closing rows in order of paths, and what running sums over both say of each node."""
    kept = ["conv_id", "parent_conv_id", "n_convs", "n_children"]
    both = nodes.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    opens = F.col("side") == 0
    both = both.select(*NODE, "side", F.when(opens, F.col("path")).otherwise(F.concat("path", F.lit(CLOSE))).alias("path"), *(F.when(opens, F.col(c)).alias(c) for c in kept), *(F.when(opens, c).otherwise(0).cast("long").alias(name) for c, name in ((F.lit(1), "w_node"), ((F.col("n_children") == 0).cast("long"), "w_leaf"), ((F.col("n_convs") - 1) * F.col("bytes"), "w_saved"))))
    sums, schema = ["w_node", "w_leaf", "w_saved"], None

    def run(batches):
        nonlocal schema
        part, so_far = TaskContext.get().partitionId(), np.zeros(3, np.int64)
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy() for c in sums])
            before = so_far[:, None] + np.cumsum(own, axis=1) - own
            so_far = so_far + own.sum(axis=1)
            schema = schema or pa.schema([*batch.schema, ("part", pa.int32()), *((f"s{k}", pa.int64()) for k in range(3))])
            yield batch_of(schema, [*batch.columns, np.full(batch.num_rows, part), *before])

    order = ["path", "depth", "side"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema)
    table = cut(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{kind}, part int, s0 long, s1 long, s2 long"), "intervals")
    totals, so_far, before = table.groupBy("part").agg(*(F.sum(c).alias(c) for c in sums)).collect(), [0, 0, 0], []  # one row a task
    for t in sorted(totals, key=lambda t: t.part):
        before.append((t.part, *so_far))
        so_far = [x + t[c] for x, c in zip(so_far, sums, strict=True)]
    offsets = F.broadcast(nodes.sparkSession.createDataFrame(before, "part int, o0 long, o1 long, o2 long"))
    opened, place = F.col("side") == 0, [F.col(f"s{k}") + F.col(f"o{k}") for k in range(3)]
    at = lambda k, side: F.max(F.when(opened == side, place[k]))
    found = table.join(offsets, "part").groupBy(*NODE).agg(*(F.max(c).alias(c) for c in kept), *(at(k, side).alias(f"{'open' if side else 'close'}{k}") for k in range(3) for side in (True, False)))
    return found.select(*NODE, *kept, *((F.col(f"close{k}") - F.col(f"open{k}")).alias(c) for k, c in ((1, "n_leaves"), (2, "saved_tokens"))), F.col("open0").alias("preorder"), F.col("close0").alias("subtree_end"))


def ends(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end: SHA-256 of their ids in numeric order, comma-joined.

    Ids come in sorted blocks; a hash of one list is a chain, so a node's blocks stream through one task.
    """
    last = turns.groupBy("conv_id").agg(F.max_by(F.struct(*NODE), "depth").alias("node"))
    at = conversations.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(f"node.{c}", F.lit(0).cast("long")).alias(c) for c in NODE))
    listed = at.groupBy(*NODE, F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])

    def run(batches):
        node = digest = None
        for batch in batches:
            done = []
            for *here, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"]), strict=True):
                if here != node:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = here, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield batch_of(schema, [list(c) for c in zip(*done, strict=True)])
        if node:
            yield batch_of(schema, [[x] for x in (*node, digest.hexdigest())])

    return listed.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(run, "depth long, id1 long, id2 long, ends_sha256 string")


def trie_sql() -> str:
    """DuckDB SQL of the rebuilt conversations' trie: prefixes are MD5 chains, subtrees are found by listing all prefixes of each node."""
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(c) + 1), lambda i: ascii(substr(c, i, 1))::bigint)), lambda a, b: " + "BYTE" + "))"
    step = "xor(a, b)"
    for _ in range(8):
        step = f"list_reduce([{step}, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, unhex(md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))) AS i FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({{'d': md5(length(role) || ':' || role || text), 'b': strlen(text)}} ORDER BY i) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, {crc.replace("BYTE", step).replace("(c", "(conv_id::varchar").replace("substr(c,", "substr(conv_id::varchar,")} % 9 AS h FROM l),
r AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h.h), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, len(turns) AS size, CASE WHEN d = 0 THEN 0 ELSE turns[d].b END AS b, md5(array_to_string(list_transform(list_slice(turns, 1, d), lambda x: x.d), '')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(list_transform(list_slice(turns, 1, d - 1), lambda x: x.d), '')) END AS up FROM r, LATERAL unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (SELECT node, d, any_value(up) AS up, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends FROM p GROUP BY node, d),
k AS (SELECT up, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
w AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON k.up = n.node),
a AS (SELECT p.node, p.d, sum((w.kids = 0)::int) AS leaves, sum((w.n - 1) * w.b) AS saved, count(*) AS size FROM w JOIN p ON p.conv_id = w.conv_id AND p.d <= w.d GROUP BY p.node, p.d),
q AS (SELECT w.*, a.leaves, a.saved, a.size, o.conv_id AS parent FROM w JOIN a USING (node, d) LEFT JOIN n o ON o.node = w.up)
SELECT conv_id::bigint AS conv_id, d::bigint AS depth, parent::bigint AS parent_conv_id, n::bigint AS n_convs, kids::bigint AS n_children, leaves::bigint AS n_leaves, saved::bigint AS saved_tokens, sha256(ends) AS ends_sha256 FROM q
"""
