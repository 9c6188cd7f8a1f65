"""Operator 13, conversation prefix trie: the conversations' common beginnings, merged family first.

Conversations of one base id are a family: they begin with turns of the base conversation, as many as the
conversation's own number says.  A family's turns meet in one task in the order of conversation and turn, where
the conversations are rebuilt and the family's own small trie is built; only combined family nodes are shuffled
to be merged.  A turn crosses as a digest of role and text and a number of words, never as text; a node is the
128-bit hash of its turns.  A family is streamed: what a task holds is the turns that it begins with and at most
FLUSH nodes, so a family of any length fits; nodes that leave a task early are merged like those of two families.

What a subtree sums up is told along paths, without walking the trie level by level.  A node is owned by its
smallest member; what a conversation owns is the lower end of its path.  So each owner tells the nodes above what
its own nodes add up to, and nodes that it owns take the sum from below.  A node with one member has one leaf and
saves nothing, and is told nothing.

Cases.  Null role or text: empty.  Null turns come first; turns with the same number are ordered by their digest,
so the result doesn't depend on the rows' order; repeated rows are turns of their own.  Rows without conv_id
belong to no conversation and are left out.  A missing base gives no turns, so a conversation may be turnless; it
is a member of the root and ends there.  Without conversations there is no root: an empty table gives an empty
result.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recordloom.llm.lookup import look_up
from recordloom.llm.storage import map_arrow, materialize, release

#: Conversation ids of one family, and turns that may come from its base at most, plus one.
FAMILY, SHARES = 20, 4
#: Nodes of a family that a task holds.
FLUSH = 50_000
#: Conversation ids whose numbers are joined in one group; families are not cut by it.
BLOCK = 200 * FAMILY
NODE = "a long, b long, parent_a long, parent_b long, depth long, words long, base long, members array<long>, ends array<long>"
ROOT = (0, 0)
NO_END = hashlib.sha256(b"").hexdigest()


def own_turns(turns: DataFrame) -> DataFrame:
    """(base, conv_id, turn, digest, words) of each row with a conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return turns.filter(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


class Family:
    """The trie of the conversations that are added one after another, base conversation first."""

    def __init__(self) -> None:
        self.base: int | None = None
        self.nodes: dict[tuple[int, int], tuple[tuple, list[int], list[int]]] = {}

    def begin(self, base: int, conv: int) -> None:
        if base != self.base:
            self.base, self.heads = base, []
        self.conv, self.skip = conv, zlib.crc32(b"%d" % conv) % SHARES
        self.at = (*ROOT, None, None, 0, 0)
        self.pass_through()
        for digest, words in [] if conv == base else self.heads[: self.skip]:
            self.step(digest, words)
        if conv == base:
            self.skip = 0

    def pass_through(self) -> None:
        self.nodes.setdefault(self.at[:2], (self.at, [], []))[1].append(self.conv)

    def step(self, digest: bytes, words: int) -> None:
        a, b, *_, depth, _ = self.at
        self.at = (*struct.unpack("<qq", hashlib.blake2b(struct.pack("<qq", a, b) + digest, digest_size=16).digest()), a, b, depth + 1, words)
        self.pass_through()

    def turn(self, digest: bytes, words: int) -> None:
        if self.conv == self.base and len(self.heads) < SHARES:
            self.heads.append((digest, words))
        if self.skip:
            self.skip -= 1
        else:
            self.step(digest, words)

    def end(self) -> None:
        self.nodes.setdefault(self.at[:2], (self.at, [], []))[2].append(self.conv)

    def flush(self) -> pa.RecordBatch:
        found = [(*at, self.base, sorted(members), sorted(ends)) for at, members, ends in self.nodes.values()]
        self.nodes = {}
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * 2
        columns = zip(*found, strict=True) if found else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in NODE.split(", ")])


def family_nodes(turns: DataFrame) -> DataFrame:
    """(NODE): the nodes of each family's trie with the members that pass through and those that end there."""
    rows = own_turns(turns).repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, open_ = Family(), None
        for batch in batches:
            bases, convs, digests, words = (batch.column(i).to_pylist() for i in range(4))
            for base, conv, digest, n in zip(bases, convs, digests, words, strict=True):
                if conv != open_:
                    if open_ is not None:
                        family.end()
                        if base != family.base and family.nodes:
                            yield family.flush()
                    family.begin(base, conv)
                    open_ = conv
                family.turn(digest, n)
                if len(family.nodes) >= FLUSH:
                    yield family.flush()
        if open_ is not None:
            family.end()
            yield family.flush()

    return map_arrow(rows.select("base", "conv_id", "digest", "words"), run, NODE)


def merge(families: DataFrame) -> DataFrame:
    """(a, b, parent_a, parent_b, depth, words, n_convs, conv_id, n_children) of every node."""
    same = [F.first(c).alias(c) for c in ("parent_a", "parent_b", "depth", "words")]
    nodes = materialize(families.groupBy("a", "b").agg(*same, F.sum(F.size("members")).alias("n_convs"), F.min(F.array_min("members")).alias("conv_id")), "trie-merged")
    below = nodes.filter("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count("*").alias("n_children"))
    out = materialize(nodes.join(below, ["a", "b"], "left").fillna(0, ["n_children"]), "trie-nodes")
    release(nodes)
    return out


def subtree_sums(nodes: DataFrame, families: DataFrame) -> DataFrame:
    """(a, b, n_leaves, saved_tokens) of every node with two members or more."""
    saved = (F.col("n_convs") - 1) * F.col("words")
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"),
        F.sum(saved).alias("saved"),
        F.max((F.col("n_children") == 0).cast("long")).alias("leaf"),
        F.coalesce(F.max(F.when(F.col("n_convs") > 1, F.col("depth"))), F.min("depth") - 1).alias("shared"),
    )
    from_below = W.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    own = nodes.filter("n_convs > 1").select("a", "b", F.lit(0).cast("long").alias("leaf"), F.sum(saved).over(from_below).alias("saved"))
    paths = families.select(F.explode("members").alias("conv_id"), "a", "b", "depth")
    told = paths.join(owners, "conv_id").filter("depth <= shared").select("a", "b", "leaf", F.when(F.col("depth") < F.col("top"), F.col("saved")).otherwise(0).alias("saved"))
    return own.unionByName(told).groupBy("a", "b").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def end_digests(families: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of every node where a conversation ends.

    The ids are first joined by blocks of BLOCK ids; a node's blocks are then hashed one after another as they stream by.
    """
    ends = families.filter(F.size("ends") > 0).select("a", "b", F.floor(F.col("base") / BLOCK).alias("block"), F.explode("ends").alias("conv_id"))
    blocks = ends.groupBy("a", "b", "block").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, so_far = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (a, b) != at:
                    if at is not None:
                        done.append((*at, so_far.hexdigest()))
                    at, so_far = (a, b), hashlib.sha256(ids.encode())
                else:
                    so_far.update(b"," + ids.encode())
            yield _digests(done)
        if at is not None:
            yield _digests([(*at, so_far.hexdigest())])

    return map_arrow(blocks.repartition("a", "b").sortWithinPartitions("a", "b", "block"), run, "a long, b long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string())], names=["a", "b", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  turns: (conv_id, turn, role, text)."""
    families = materialize(family_nodes(turns), "trie-families")
    nodes = merge(families)
    told = nodes.join(subtree_sums(nodes, families), ["a", "b"], "left").join(end_digests(families), ["a", "b"], "left")
    told = materialize(told, "trie-told")
    release(families)
    parents = nodes.filter("n_children > 0").select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = look_up(told.filter("depth > 0"), parents.withColumnRenamed("n_children", "asked"), ["parent_a", "parent_b"], "asked", "trie-parents")
    whole = below.unionByName(told.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    shared = F.col("n_convs") > 1
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.when(shared, F.col("n_leaves")).otherwise(1).alias("n_leaves"),
        F.when(shared, F.col("saved_tokens")).otherwise(0).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_END)).alias("ends_sha256"),
    )


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_SHARE = (
    "xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
    "lambda h, x: list_reduce(list_concat([xor(h, x)], range(8)), lambda d, i: xor(d >> 1, (d & 1) * 3988292384))), 4294967295) % 4"
)
ORACLE_SQL = rf"""
WITH own AS (SELECT conv_id AS c, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
share AS (SELECT c, {_SHARE} AS h FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (SELECT share.c, i, k, words FROM share JOIN own ON own.c = share.c - share.c % {FAMILY} AND i <= h UNION ALL SELECT own.c, i, k, words FROM own JOIN share USING (c) WHERE i > h),
path AS (SELECT c, row_number() OVER p AS depth, words, md5(string_agg(k, '') OVER p) AS node, lag(k) OVER p IS NULL AS top FROM rebuilt WINDOW p AS (PARTITION BY c ORDER BY i)
  UNION ALL SELECT c, 0, 0, '', FALSE FROM share),
way AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY c) AS last FROM path),
nodes AS (SELECT node, any_value(parent) AS parent, min(c) AS conv_id, depth, any_value(words) AS words, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM way GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
sums AS (SELECT w.node, w.depth, count(*) FILTER (n.node NOT IN (SELECT node FROM children)) AS n_leaves, sum((n_convs - 1) * n.words) AS saved_tokens FROM nodes n JOIN way w ON w.c = n.conv_id AND w.depth <= n.depth GROUP BY w.node, w.depth)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (node, depth) LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children ON children.node = n.node
"""
