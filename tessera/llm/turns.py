"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. Peeling descends from the greatest depth: the nodes of a
depth are the conversations that end there merged with what survives from below; each node is summed
up and written, then its last turn is stripped and the rest regrouped. Nodes are discovered and summed
in one pass, every turn is touched once.

A turn is known by a digest, a sequence by the chain of digests of its prefixes; texts are not moved.
Equal conversations become one row first (their ids in blocks, joined and hashed as a sorted stream).
Then a subtree of at most LIGHT turns is peeled within a task, many subtrees of a task at a time. What lies
above (the root, and prefixes that more turns share) is peeled depth by depth as aggregations with
partial sums, so a first turn that a third of all conversations share is a few rows a task. A loop finds
where subtrees become light; it takes as many steps as such prefixes are deep, whatever the depth of the trie.

Defined results: a row without conv_id is in no conversation; null role and text are empty; turns with
one number are ordered by their digest (repeated rows count as turns); an empty table has no nodes; conversations
without turns are members of the root; other columns are ignored. A conversation's digests (16 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import released, stored, table

#: Turns of distinct conversations that a subtree peeled within a task may have.
LIGHT = 2048
#: Conversation ids of a block, joined within one row.
BLOCK = 4096
#: Rows that are sent to all tasks, at most; beyond, tables are joined by a shuffle.
SENT_ROWS = 100_000
#: Turns that a task peels at a time, besides a last subtree.
AT_ONCE = 20_000
#: Bytes of a prefix's digest.
DIGEST = 16

CHAINED = "conv_id long, node binary, depth int, chain binary, words array<long>"
DISTINCT = "node binary, depth int, conv_id long, n_convs long, ends_sha256 string, chain binary, words array<long>"
NODES = "node binary, parent binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean, chain binary, words array<long>"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame, within: Column | None = None) -> DataFrame:
    """conv_id and its turns in order (mark: a digest in hex, words); rows of one ``within`` stay in one partition."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), mark.alias("mark"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).alias("turn")
    )
    keyed = turns.withColumn("within", within if within is not None else F.col("conv_id")).repartition("within")
    return keyed.groupBy("within", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks become the chain of the digests of all prefixes."""

    def chain(marks: str) -> bytes:
        raw, last, out = bytes.fromhex(marks), b"", []
        for at in range(0, len(raw), DIGEST):
            last = hashlib.blake2b(last + raw[at : at + DIGEST], digest_size=DIGEST).digest()
            out.append(last)
        return b"".join(out)

    for batch in batches:
        chains = [chain(m) for m in batch["marks"]]
        yield pd.DataFrame({"conv_id": batch["conv_id"], "node": [c[-DIGEST:] for c in chains], "depth": [len(c) // DIGEST for c in chains], "chain": chains, "words": batch["words"]})


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of ids, sorted by node and block, to one row a node; ids are hashed as they pass."""
    state = None

    def row():
        first, ids, n = state
        return (first.node, first.depth, first.least, n, ids.hexdigest(), first.chain, first.words)

    names = [c.split()[0] for c in DISTINCT.split(", ")]
    for batch in batches:
        done = []
        for r in batch.itertuples(index=False):
            if state and state[0].node == r.node:
                state[1].update(b"," + r.ids.encode())
                state = (state[0], state[1], state[2] + r.n)
            else:
                if state:
                    done.append(row())
                state = (r, hashlib.sha256(r.ids.encode()), r.n)
        yield pd.DataFrame(done, columns=names)
    if state:
        yield pd.DataFrame([row()], columns=names)


def distinct_conversations(chained: DataFrame) -> DataFrame:
    """One row a distinct conversation: its node, least id, number of copies and the digest of their ids."""
    blocks = chained.groupBy("node", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("own"), F.first("depth").alias("depth"), F.first("chain").alias("chain"), F.first("words").alias("words")
    )
    joined = blocks.select("node", "block", "depth", F.col("own")[0].alias("least"), F.size("own").cast("long").alias("n"), F.array_join(F.col("own").cast("array<string>"), ",").alias("ids"), "chain", "words")
    return stored(joined.repartition("node").sortWithinPartitions("node", "block").mapInPandas(_whole, DISTINCT), "conversations")


def _at(depth: int, chain: str = "chain") -> Column:
    return F.substring(chain, DIGEST * (depth - 1) + 1, DIGEST) if depth else F.lit(b"")


def _sent(small: DataFrame) -> DataFrame:
    """To be sent to all tasks if it is small indeed."""
    return F.broadcast(small) if small.limit(SENT_ROWS + 1).count() <= SENT_ROWS else small


def split_by_weight(distinct: DataFrame, light: int = LIGHT) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The conversations in light subtrees (key: the subtree's top; cut: its depth), and those that end above, by depth."""
    rest, depth, parts, ended = distinct, 1, [], {}
    while True:
        ended[depth - 1] = rest.filter(F.col("depth") < depth)
        going = rest.filter(F.col("depth") >= depth).withColumn("key", _at(depth))
        heavy = stored(going.groupBy("key").agg(F.sum("depth").alias("turns")).filter(F.col("turns") > light).select("key"), "heavy")
        if heavy.isEmpty():
            parts.append(going.withColumn("cut", F.lit(depth)))
            return reduce(DataFrame.unionByName, parts), ended
        sent = _sent(heavy)
        parts.append(going.join(sent, "key", "left_anti").withColumn("cut", F.lit(depth)))
        rest = stored(going.join(sent, "key", "left_semi").select(*distinct.columns), "rest")
        depth += 1


class _Node:
    __slots__ = ("row", "conv_id", "n", "children", "leaves", "saved", "ends")

    def __init__(self, row):
        self.row, self.conv_id, self.n, self.children, self.leaves, self.saved, self.ends = row, row.conv_id, 0, 0, 0, 0, NO_ENDS


def peel(rows: list) -> list[tuple]:
    """All nodes of whole subtrees, from their conversations (cut: depth of the subtree's top)."""
    ending = defaultdict(list)
    for r in rows:
        ending[r.depth].append(r)
    out, below = [], {}

    def emit(node: bytes, x: _Node, depth: int, parent: bytes, parent_conv: int | None) -> None:
        top = parent_conv is None
        out.append((node, parent, depth, x.conv_id, parent_conv, x.n, x.children, x.leaves, x.saved, x.ends, top, x.row.chain[: DIGEST * depth] if top else None, x.row.words[:depth] if top else None))

    for depth in range(max(ending, default=-1), -1, -1):
        nodes: dict[bytes, _Node] = {}
        stripped = []
        for node, x in below.items():  # of depth + 1
            parent = x.row.chain[DIGEST * (depth - 1) : DIGEST * depth] if depth else b""
            if x.row.cut > depth:
                emit(node, x, depth + 1, parent, None)
                continue
            p = nodes.get(parent) or nodes.setdefault(parent, _Node(x.row))
            p.conv_id, p.n, p.children, p.leaves, p.saved = min(p.conv_id, x.conv_id), p.n + x.n, p.children + 1, p.leaves + x.leaves, p.saved + x.saved
            stripped.append((node, x, parent))
        for r in ending[depth]:
            x = nodes.get(r.node) or nodes.setdefault(r.node, _Node(r))
            x.conv_id, x.n, x.ends = min(x.conv_id, r.conv_id), x.n + r.n_convs, r.ends_sha256
        for x in nodes.values():
            x.leaves = x.leaves or 1
            x.saved += (x.n - 1) * int(x.row.words[depth - 1]) if depth else 0
        for node, x, parent in stripped:
            emit(node, x, depth + 1, parent, nodes[parent].conv_id)
        below = nodes
    return out


def _peel_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations sorted by subtree, some whole subtrees at a time."""
    names = [c.split()[0] for c in NODES.split(", ")]
    held, turns = [], 0
    for batch in batches:
        for r in batch.itertuples(index=False):
            if turns >= AT_ONCE and r.key != held[-1].key:
                yield pd.DataFrame(peel(held), columns=names).astype({"parent_conv_id": "Int64"})
                held, turns = [], 0
            held.append(r)
            turns += r.depth
    if held:
        yield pd.DataFrame(peel(held), columns=names).astype({"parent_conv_id": "Int64"})


def _level(depth: int, children: list[DataFrame], ending: DataFrame | None) -> DataFrame:
    """The heavy nodes of a depth: the nodes below them with their last turn stripped, merged with the conversations that end here."""
    own = "chain", F.substring("chain", 1, DIGEST * depth), "words", F.slice("words", 1, depth)
    fields = lambda node, n_children, leaves, saved, ends: [
        node.alias("node"), F.col("conv_id"), F.col("n_convs"), n_children.cast("long").alias("n_children"), leaves.cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"), ends.alias("ends_sha256"),
        own[1].alias(own[0]), own[3].alias(own[2]),
    ]
    rows = [c.select(*fields(F.col("parent"), F.lit(1), F.col("n_leaves"), F.col("saved_tokens"), F.lit(None).cast("string"))) for c in children]
    if ending is not None:
        rows.append(ending.select(*fields(F.col("node"), F.lit(0), F.lit(0), F.lit(0), F.col("ends_sha256"))))
    total = reduce(DataFrame.unionByName, rows).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.coalesce(F.max("ends_sha256"), F.lit(NO_ENDS)).alias("ends_sha256"), F.first("chain").alias("chain"), F.first("words").alias("words"),
    )
    last = F.element_at("words", depth) if depth else F.lit(0)
    return total.select(
        "node", (_at(depth - 1) if depth else F.lit(None).cast("binary")).alias("parent"), F.lit(depth).alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * last).alias("saved_tokens"), "ends_sha256", F.lit(True).alias("top"), "chain", "words",
    )


def prefix_trie(sequences: DataFrame, light: int = LIGHT) -> DataFrame:
    """The nodes of the trie over (conv_id, turns): node and parent (digests), depth, conv_id (least member), parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    marks = F.array_join(F.transform("turns", lambda t: t["mark"]), "")
    chained = sequences.select("conv_id", marks.alias("marks"), F.transform("turns", lambda t: t["words"]).alias("words")).mapInPandas(_chains, CHAINED)
    conversations, ended = split_by_weight(distinct_conversations(chained), light)
    peeled = stored(conversations.repartition("key").sortWithinPartitions("key").mapInPandas(released(_peel_sorted), NODES), "peeled")
    heavy, levels = None, []
    for depth in range(max(ended), -1, -1):
        children = [peeled.filter(F.col("top") & (F.col("depth") == depth + 1))] + ([heavy] if heavy is not None else [])
        heavy = stored(_level(depth, children, ended[depth]), "level")
        levels.append(heavy)
    above = reduce(DataFrame.unionByName, levels)
    parents = _sent(above.select(F.col("node").alias("parent"), F.col("conv_id").alias("found")))
    tops = peeled.filter("top").unionByName(above).join(parents, "parent", "left").withColumn("parent_conv_id", F.col("found")).drop("found")
    return peeled.filter("NOT top").unionByName(tops).drop("top", "chain", "words")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation with its first few turns taken from the first conversation of its twenty."""
    first = F.col("conv_id") - F.col("conv_id") % 20
    own = sequences(conversations, first.cast("long"))
    head = F.first(F.when(F.col("conv_id") == F.col("within"), F.slice("turns", 1, 3)), ignorenulls=True).over(Window.partitionBy("within"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), n), F.slice("turns", n + 1, F.size("turns")))
    return own.withColumn("head", head).select("conv_id", turns.alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {
    "op13_prefix_trie": """
        WITH crc AS (
            SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS step
            FROM range(256) AS r(i)
        ), t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list({'mark': mark, 'words': len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))} ORDER BY turn NULLS FIRST, mark) AS turns
            FROM t GROUP BY conv_id
        ), h AS (
            SELECT conv_id, turns, xor(list_reduce(
                       list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 4 AS h
            FROM own, crc
        ), rebuilt AS (
            SELECT h.conv_id, list_concat(coalesce(f.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns
            FROM h LEFT JOIN own AS f ON f.conv_id = h.conv_id - h.conv_id % 20
        ), prefixes AS (
            SELECT conv_id, len(turns) AS n, d, array_to_string(list_transform(turns[1:d], lambda x: x.mark), '') AS node, coalesce(turns[d].words, 0) AS words
            FROM rebuilt, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)
        ), nodes AS (
            SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE any_value(words) END) AS saved,
                   sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
            FROM prefixes GROUP BY node, d
        ), children AS (
            SELECT substr(node, 1, 64 * (d - 1)) AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
        ), sums AS (
            SELECT substr(x.node, 1, 64 * k) AS node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved
            FROM nodes AS x LEFT JOIN children AS c ON c.node = x.node, LATERAL (SELECT unnest(range(x.d + 1)) AS k)
            GROUP BY 1
        )
        SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
               s.saved::BIGINT AS saved_tokens, x.ends_sha256
        FROM nodes AS x JOIN sums AS s ON s.node = x.node LEFT JOIN children AS c ON c.node = x.node
             LEFT JOIN nodes AS p ON x.d > 0 AND p.node = substr(x.node, 1, 64 * (x.d - 1))
    """
}
