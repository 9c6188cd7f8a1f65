"""Operator 8, n-gram Jaccard join: a grouped prefix join over word shingles, then components of its links.

1. A text's set is its distinct N-word shingles as 64-bit hashes; equal sets are one class, whose id is a
   hash of the set, so copies collapse before anything is joined.
2. Shingles are dealt to shards by hash, packed in binary columns; a task deals a class once.  There is a shard
   for each SHARD_SHINGLES shingles.  A shard counts in how many classes each shingle occurs and returns those in
   two or more to their classes.  A shingle in one class only can't be shared, so a class is dropped if its
   prefix, taken in order of rarity, has no other kind.  Shingles of very many texts, found by a lossy count in
   every task while the texts are described, aren't counted: they are the least rare ones, of which there are
   HOT_SHINGLES at most, and their occurrences are dealt out by class as well.
3. Classes with the same prefix and size are one group.  Classes that share a first or last prefix shingle
   are compared in bounded chunks; that links most copies at little cost, and components of it are taken.
   Then, for each prefix shingle, the most central classes of its components are compared with one hub.
4. Completeness: prefix shingles that still meet two or more components are joined, once for each group and
   component; pairs within the size and positional bounds are expanded to members and all are verified.
   A pair within one component needs no comparison: the result is the components.

Every comparison is of the whole sets.  No group or component is gathered in one task, nor any shingle's classes.

Cases.  Null and empty text, or text without words: an empty set, linked with nothing, its own component.
Fewer than N words: one shingle.  Repeated rows, also of one doc_id, are each returned and are copies of
each other.  A null doc_id takes part; it is a component's id only if all of its ids are null.  An empty
table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import wordhash as wh
from recordloom.llm.components import components
from recordloom.llm.storage import documents, map_arrow, materialize, release

N = 5
PERCENT = 80
#: Classes that are compared with each other in one chunk of step 3, about, and the clusters of it that a class is compared with.
CHUNK, LOOKBACK = 256, 16
HUB_ROUNDS = 2
#: Shingles that a task counts, about.
SHARD_SHINGLES = 1 << 20
#: A shingle is dealt out by class if it is in so many texts at least, and in a HOT_SHINGLES-th of all shingles.
HOT_TEXTS, HOT_SHINGLES = 1 << 18, 1 << 16


def class_sets(part: wh.Slice, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, text), and each text's set size and class id."""
    h, owner, _ = wh.distinct(*wh.shingles(wh.words(part), n, short=True))
    sizes = np.bincount(owner, minlength=len(part.offsets) - 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(wh.mix(h ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return h, owner, sizes, wh.mix(total[bounds[1:]] - total[bounds[:-1]] + sizes.astype(np.uint64))


def _blob(a: np.ndarray, kind: type) -> bytes:
    return a.astype(kind).tobytes()


def _joined(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    """The partition's binary columns, each as one array."""
    found: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
    for batch in batches:
        for c, kind in kinds.items():
            found[c] += [np.frombuffer(v, kind) for v in batch.column(c).to_pylist()]
    return {c: np.concatenate(v) if v else np.zeros(0, kinds[c]) for c, v in found.items()}


def _equal(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of the runs of equal values."""
    bounds = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else [0]
    yield from pairwise(bounds)


def _rows(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, names.values(), strict=True)], names=list(names))


class _Fresh:
    """The classes that a task has met."""

    def __init__(self) -> None:
        self._seen: set[int] = set()

    def first(self, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which texts are the first of their class."""
        found = np.zeros(len(ids), bool)
        for i, (n, c) in enumerate(zip(sizes.tolist(), ids.tolist(), strict=True)):
            if n and c not in self._seen:
                self._seen.add(c)
                found[i] = True
        return found


class _Frequent:
    """A lossy count of shingles: those in more texts than there were slices are kept, counted too low by as many at most."""

    def __init__(self) -> None:
        self.keys, self.counts, self.since, self.slices = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, h: np.ndarray) -> None:
        self.slices += 1
        h, n = np.unique(h, return_counts=True)
        at = np.searchsorted(self.keys, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == h[inside]
        self.counts[at[known]] += n[known]
        new = ~known & (n > 1)
        keys = np.concatenate([self.keys, h[new]])
        counts = np.concatenate([self.counts, n[new]])
        since = np.concatenate([self.since, np.full(int(new.sum()), self.slices - 1)])
        kept = np.flatnonzero(counts + since > self.slices)
        kept = kept[np.argsort(keys[kept], kind="stable")]
        self.keys, self.counts, self.since = keys[kept], counts[kept], since[kept]

    def most(self) -> tuple[np.ndarray, np.ndarray]:
        often = self.counts > self.slices
        return self.keys[often], self.counts[often]


def describe(docs: DataFrame, keep: list[str], text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The kept columns, n_shingles and cls (null for an empty set) of each row; and (shingle, n) of shingles that are frequent within tasks."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), "n_shingles long, cls long, shingle long, n long"])
    names = [*keep, "n_shingles", "cls", "shingle", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, frequent, kinds = _Fresh(), _Frequent(), []
        for batch in batches:
            found, kinds = [], [c.type for c in batch.columns[: len(keep)]]
            for part in wh.slices(batch.column(len(keep))):
                h, owner, sizes, ids = class_sets(part, n)
                frequent.add(h[fresh.first(sizes, ids)[owner]])
                found.append((sizes, ids))
            sizes = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            ids = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes.astype(np.int64)), pa.array(ids.view(np.int64), mask=sizes == 0), none, none], names=names)
        keys, counts = frequent.most()
        if len(keys):
            none = [pa.nulls(len(keys), t) for t in (*kinds, pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(keys.view(np.int64)), pa.array(counts)], names=names)

    described = materialize(map_arrow(source, run, schema), "jaccard-rows")
    return described.filter("shingle IS NULL").drop("shingle", "n"), described.filter("shingle IS NOT NULL").select("shingle", "n")


def hot_shingles(frequent: DataFrame, total: int) -> np.ndarray:
    """The shingles of (shingle, n) that are in very many of all texts, in order; HOT_SHINGLES at most."""
    least = max(HOT_TEXTS, -(-total // HOT_SHINGLES))
    return np.sort(np.array([r.shingle for r in frequent.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()], np.int64).view(np.uint64))


_SHARDED = {"shard": pa.int32(), "hot": pa.bool_(), "cls": pa.binary(), "size": pa.binary(), "cnt": pa.binary(), "lo": pa.binary(), "hi": pa.binary()}
_SHARED = {"home": pa.int32(), "cls": pa.binary(), "size": pa.binary(), "cnt": pa.binary(), "tok": pa.binary(), "code": pa.binary()}


def _ddl(names: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {({pa.int32(): 'int', pa.bool_(): 'boolean'}).get(t, 'binary')}" for c, t in names.items())


def shared_shingles(docs: DataFrame, text: str, n: int, shards: int, hot: np.ndarray) -> DataFrame:
    """Packed rows by home (a class's partition) of the shingles that occur in two or more classes, with a rarity code.

    A shingle's token is its shard and the low bits of its hash; of a hot one, the number of shards and its place among the hot ones.
    """
    kind = np.uint16 if shards < 1 << 16 else np.uint32  # short ones sort faster
    low = np.uint64(min(48, 64 - shards.bit_length()))
    mask = (np.uint64(1) << low) - np.uint64(1)

    def rows_of(h: np.ndarray, owner: np.ndarray, shard: np.ndarray, sizes: np.ndarray, ids: np.ndarray, is_hot: bool) -> Iterator[tuple]:
        order = np.argsort(shard, kind="stable")
        h, owner, shard = h[order], owner[order], shard[order]
        first = np.ones(len(h), bool)
        first[1:] = (shard[1:] != shard[:-1]) | (owner[1:] != owner[:-1])
        runs = np.flatnonzero(first)
        counts = np.diff(np.append(runs, len(h)))
        for a, b in _equal(shard):
            r, q = np.searchsorted(runs, (a, b))
            own = owner[runs[r:q]]
            yield int(shard[a]), is_hot, _blob(ids[own], np.uint64), _blob(sizes[own], np.uint32), _blob(counts[r:q], np.uint32), _blob(h[a:b] & np.uint64(0xFFFFFFFF), np.uint32), _blob(h[a:b] >> np.uint64(32), np.uint16)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for batch in batches:
            for part in wh.slices(batch.column(0)):
                h, owner, sizes, ids = class_sets(part, n)
                kept = fresh.first(sizes, ids)[owner]
                h, owner = h[kept], owner[kept]
                shard = (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(kind)
                out = []
                if len(hot):
                    place = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    often = hot[place] == h
                    by_class = (wh.mix(h[often] ^ ids[owner[often]]) % np.uint64(shards)).astype(kind)
                    out += rows_of(place[often].astype(np.uint64), owner[often], by_class, sizes, ids, True)
                    h, owner, shard = h[~often], owner[~often], shard[~often]
                out += rows_of(h & mask, owner, shard, sizes, ids, False)
                yield _rows(_SHARDED, out)

    def postings(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """token, class and size of a shard's rows, each pair of token and class once, in order."""
        if not rows:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        ids, sizes, counts = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in ((1, np.uint64), (2, np.uint32), (3, np.uint32)))
        tokens = np.concatenate([np.frombuffer(r[4], np.uint32) | (np.frombuffer(r[5], np.uint16).astype(np.uint64) << np.uint64(32)) | (np.uint64(r[0]) << low) for r in rows])
        rows.clear()
        run = np.repeat(np.arange(len(ids), dtype=np.uint32), counts)
        own = ids[run]
        order = np.lexsort((own, tokens))
        tokens, own, run, order = tokens[order], own[order], run[order], None
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (own[1:] != own[:-1])
        return tokens[fresh], own[fresh], sizes[run[fresh]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, often = [], []
        for batch in batches:
            for s, is_hot, *rest in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                (often if is_hot else plain).append((shards if is_hot else s, *rest))
        tokens, own, size = postings(plain)
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        df = np.diff(np.append(np.flatnonzero(first), len(tokens)))
        df = np.repeat(df, df)
        many = df > 1
        tokens, own, size, df = tokens[many], own[many], size[many], df[many]
        code = np.minimum(254, 4 * np.log2(df)).astype(np.uint8)
        if often:
            hot_tokens, hot_own, hot_size = postings(often)
            tokens, own, size = np.concatenate([tokens, hot_tokens]), np.concatenate([own, hot_own]), np.concatenate([size, hot_size])
            code = np.concatenate([code, np.full(len(hot_tokens), 255, np.uint8)])
        home = (own % np.uint64(shards)).astype(kind)
        order = np.lexsort((own, home))
        tokens, own, code, home, size = tokens[order], own[order], code[order], home[order], size[order]
        first = np.ones(len(own), bool)
        first[1:] = own[1:] != own[:-1]
        runs = np.flatnonzero(first)
        counts = np.diff(np.append(runs, len(own)))
        for a, b in _equal(home):
            r, q = np.searchsorted(runs, (a, b))
            yield _rows(_SHARED, [(int(home[a]), _blob(own[runs[r:q]], np.uint64), _blob(size[runs[r:q]], np.uint32), _blob(counts[r:q], np.uint32), _blob(tokens[a:b], np.uint64), _blob(code[a:b], np.uint8))])

    dealt = map_arrow(docs.select(text), deal, _ddl(_SHARDED))
    return map_arrow(dealt.repartitionById(shards, F.col("shard")), count, _ddl(_SHARED)).repartitionById(shards, F.col("home"))


def prefix_length(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return size - (percent * size + 99) // 100 + 1


def candidate_classes(shared: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(cls, size, single, shared, gid, prefix, ends, toks): the classes that may link with another.

    single: shingles of no other class, which come first in the order of rarity; prefix: the rest of the
    prefix, in that order; ends: its first and last shingle, each with the classes in which it occurs, about.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _joined(batches, {"cls": np.uint64, "size": np.uint32, "cnt": np.uint32, "tok": np.uint64, "code": np.uint8})
        own, size = np.repeat(got["cls"], got["cnt"]), np.repeat(got["size"], got["cnt"])
        order = np.lexsort((got["tok"], got["code"], own))
        own, size, tok, code = own[order], size[order].astype(np.int64), got["tok"][order], got["code"][order]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        held = np.diff(np.append(starts, len(own)))
        single = size[starts] - held
        taken = prefix_length(size[starts], percent) - single
        out = []
        for i in np.flatnonzero(taken > 0):
            a, b, k = starts[i], starts[i] + held[i], int(taken[i])
            head = tok[a : a + k].view(np.int64)
            gid = own[a : a + 1] if single[i] else wh.mix(wh.mix(tok[a : a + k] + np.arange(k, dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True) + size[a : a + 1].astype(np.uint64))
            ends = [{"token": int(head[j]), "df": int(2 ** (min(int(code[a + j]) + 1, 160) / 4))} for j in {0, k - 1}]
            out.append((int(own[a : a + 1].view(np.int64)[0]), int(size[a]), int(single[i]), int(held[i]), int(gid.view(np.int64)[0]), head.tolist(), ends, np.sort(tok[a:b]).tobytes()))
            if len(out) == 500:
                yield _rows(names, out)
                out = []
        yield _rows(names, out)

    names = {"cls": pa.int64(), "size": pa.int64(), "single": pa.int64(), "shared": pa.int64(), "gid": pa.int64(), "prefix": pa.list_(pa.int64()), "ends": pa.list_(pa.struct([("token", pa.int64()), ("df", pa.int64())])), "toks": pa.binary()}
    return map_arrow(shared, run, "cls long, size long, single long, shared long, gid long, prefix array<long>, ends array<struct<token: long, df: long>>, toks binary")


def similar(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, percent: int) -> bool:
    """Whether two sets, given by their shared shingles (sorted) and whole sizes, link."""
    if percent * max(size_a, size_b) > 100 * min(size_a, size_b):
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (size_a + size_b - common)


def chunk_links(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links found by comparing classes that share a prefix's first or last shingle, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, out = None, [], []
        for batch in batches:
            for token, chunk, cls, size, toks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (token, chunk):
                    key, seen = (token, chunk), []
                own = np.frombuffer(toks, np.uint64)
                for other, other_size, other_toks in seen:
                    if similar(own, other_toks, size, other_size, percent):
                        out.append((other, cls))
                        break
                else:
                    # the most central clusters and the latest ones stay in view
                    seen = [*seen[: LOOKBACK // 2], *seen[LOOKBACK // 2 :][1 - LOOKBACK // 2 :], (cls, size, own)]
            yield _rows({"a": pa.int64(), "b": pa.int64()}, out)
            out = []

    ends = classes.select("cls", "size", "single", "toks", F.explode("ends").alias("e"))
    chunk = F.pmod(F.xxhash64("cls"), F.greatest(F.col("e.df") / CHUNK, F.lit(1)).cast("long"))
    dealt = ends.select(F.col("e.token").alias("token"), chunk.alias("chunk"), "cls", "size", "toks", "single").repartition("token", "chunk").sortWithinPartitions("token", "chunk", "single", "cls").drop("single")
    return map_arrow(dealt, run, "a long, b long")


def _bounds(percent: int) -> Column:
    """The size bound, and the positional bound where the shared shingle is a pair's first."""
    small, large = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    rest = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    held = F.least("a.shared", "b.shared")
    need = percent * (F.col("a.size") + F.col("b.size"))
    return (percent * large <= 100 * small) & ((rest + 1) * (100 + percent) >= need) & (held * (100 + percent) >= need)


def placed_classes(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The classes with comp, the component that they are in so far."""
    known = classes.select("cls", "size", "single", "shared", "gid", "prefix").join(roots, F.col("cls") == F.col("node"), "left")
    return materialize(known.withColumn("comp", F.coalesce("root", "cls")).drop("node", "root"), "jaccard-placed")


def mixed_postings(placed: DataFrame) -> DataFrame:
    """(token, gid, comp, cls, size, single, shared, at) of prefix shingles that meet several components; one member stands for a group's members of a component."""
    heads = placed.groupBy("gid", "comp").agg(F.min("cls").alias("cls"))
    listed = placed.join(heads.select("cls"), "cls").select("cls", "gid", "comp", "size", "single", "shared", F.posexplode("prefix").alias("i", "token"))
    posted = materialize(listed.withColumn("at", F.col("single") + F.col("i") + 1).drop("i"), "jaccard-postings")
    mixed = posted.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most").select("token")
    return materialize(posted.join(mixed, "token"), "jaccard-mixed")


def hub_pairs(posted: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): for each shingle, the most central class of its largest component with that of every other one (central: fewest shingles of its own)."""
    member = F.struct("single", "cls", "comp", "size", "shared", "at")
    centers = posted.groupBy("token", "comp").agg(F.count("*").alias("n"), F.min(member).alias("c")).select("token", "n", "c")
    hubs = centers.groupBy("token").agg(F.max(F.struct("n", "c")).alias("h")).select("token", F.col("h.c").alias("c"))
    return centers.select("token", "c.*").alias("a").join(hubs.select("token", "c.*").alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") != F.col("b.comp")) & _bounds(percent)).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()


def remaining_pairs(placed: DataFrame, posted: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): the pairs of classes in two components that share a prefix shingle within the bounds."""
    pairs = posted.alias("a").join(posted.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") < F.col("b.comp")) & _bounds(percent))
    groups = pairs.select(F.col("a.gid").alias("ga"), F.col("a.comp").alias("ca"), F.col("b.gid").alias("gb"), F.col("b.comp").alias("cb")).distinct()
    members = placed.select("cls", "gid", "comp")
    one = members.select(F.col("cls").alias("a"), F.col("gid").alias("ga"), F.col("comp").alias("ca"))
    two = members.select(F.col("cls").alias("b"), F.col("gid").alias("gb"), F.col("comp").alias("cb"))
    return groups.join(one, ["ga", "ca"]).join(two, ["gb", "cb"]).select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield _rows({"a": pa.int64(), "b": pa.int64()}, [(a, b) for a, b, sa, sb, ta, tb in rows if similar(np.frombuffer(ta, np.uint64), np.frombuffer(tb, np.uint64), sa, sb, percent)])

    one = classes.select(F.col("cls").alias("a"), F.col("size").alias("sa"), F.col("toks").alias("ta"))
    two = classes.select(F.col("cls").alias("b"), F.col("size").alias("sb"), F.col("toks").alias("tb"))
    return map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb", "ta", "tb"), run, "a long, b long")


def linked_components(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of all links between the classes."""
    roots = components(chunk_links(classes, percent))
    for last in (*[False] * HUB_ROUNDS, True):
        placed = placed_classes(classes, roots)
        posted = mixed_postings(placed)
        pairs = materialize(remaining_pairs(placed, posted, percent) if last else hub_pairs(posted, percent), "jaccard-pairs")
        found = materialize(verified(pairs, classes, percent), "jaccard-links")
        if not found.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        release(placed, posted, pairs, found)
    return roots


def placed_rows(docs: DataFrame, keep: list[str], text: str, n: int, percent: int) -> DataFrame:
    """The kept columns, n_shingles, cls and comp (a class of the row's component; null for an empty set) of each row."""
    rows, frequent = describe(docs.select(*keep, F.col(text).alias("text")), keep, "text", n)
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    shards = max(8, -(-total // SHARD_SHINGLES))
    classes = materialize(candidate_classes(shared_shingles(docs, text, n, shards, hot_shingles(frequent, total)), percent), "jaccard-classes")
    roots = linked_components(classes, percent)
    release(classes)
    return rows.join(roots, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "cls")).drop("node", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, cls and component_id of each row."""
    keyed = placed_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", n, percent)
    ids = materialize(keyed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least")), "jaccard-ids")
    return keyed.join(ids, "comp", "left").select("doc_id", "n_shingles", "cls", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component, and one of equal rows without a set.

    A row is its id and the hash of its text, so an id that stands for different texts is judged text by text.
    The smallest (id, hash) is kept, null ids last; of rows that repeat both, the smallest by all columns.
    """
    key = F.xxhash64(text)
    keyed = placed_rows(docs.select(F.col(doc_id).alias("__id"), key.alias("__key"), F.col(text).alias("text")), ["__id", "__key"], "text", N, PERCENT)
    best = materialize(keyed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__key").alias("key"))).alias("best")), "jaccard-best")
    kept = F.col("__id").eqNullSafe(F.col("best.id")) & (F.col("__key") == F.col("best.key"))
    found = materialize(keyed.join(best, "comp", "left").select("__id", "__key", (F.col("comp").isNotNull() & ~kept).alias("__drop")), "jaccard-found")
    drop = materialize(found.filter("__drop").select("__id", "__key").distinct(), "jaccard-drop")
    again = materialize(found.filter("NOT __drop").groupBy("__id", "__key").agg(F.count("*").alias("n")).filter("n > 1").select("__id", "__key"), "jaccard-again")
    same = lambda rows, keys: rows[doc_id].eqNullSafe(keys["__id"]) & (F.xxhash64(rows[text]) == keys["__key"])
    # what is dropped grows with the documents: one plan at every size
    left = docs.join(drop.hint("shuffle_hash"), same(docs, drop), "left_anti")
    if again.isEmpty():
        return left
    once = left.join(again, same(left, again), "left_anti")
    repeated = left.join(again, same(left, again), "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    single = repeated.groupBy(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__key")).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return once.unionByName(single.select("__row.*"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT r, doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {N - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {N - 1}], ' '))) AS s FROM docs WHERE len(w) > 0),
toks AS (SELECT r, len(s) AS n, hash(unnest(s)) AS t FROM sets),
df AS (SELECT t, count(*) AS c FROM toks GROUP BY t),
used AS (SELECT r, n, toks.t, row_number() OVER (PARTITION BY r ORDER BY c, toks.t) AS p FROM toks JOIN df ON df.t = toks.t),
pre AS (SELECT r, n, t FROM used WHERE p <= n - ({PERCENT} * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.r AS a, b.r AS b FROM pre a JOIN pre b ON a.t = b.t AND a.r < b.r WHERE {PERCENT} * greatest(a.n, b.n) <= 100 * least(a.n, b.n)),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM cand JOIN sets x ON x.r = cand.a JOIN sets y ON y.r = cand.b WHERE 100 * len(list_intersect(x.s, y.s)) >= {PERCENT} * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT docs.doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, least(docs.doc_id, coalesce(m, docs.doc_id)) AS component_id
FROM docs LEFT JOIN sets ON sets.r = docs.r LEFT JOIN least ON least.a = docs.doc_id
"""
