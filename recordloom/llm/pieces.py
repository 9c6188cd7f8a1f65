"""Operator 6, SentencePiece encoding and decoding by a streaming Viterbi search.

The pieces file is a BPE model, so the best path is the one that BPE's merges give, and a step from one
piece to the next is allowed if the two would stay apart when encoded together.  Each position then has one
surviving backpointer.  The search keeps a window of positions no longer than the longest piece can bridge;
whenever the paths of all survivors meet in one boundary, the ids before it are committed.  An Aho-Corasick automaton over the pieces
lists those that end at a position.  No piece reaches from another character to a following space mark, nor
over a line break, so all paths meet there: texts are cut there, and ids of short units are remembered in two
bounded generations, of which the older is dropped when the newer is full.

Cases.  Null and empty text: no ids.  Very long texts, also without any space: encoded whole in bounded
memory.  Characters without a piece become byte pieces.  U+2581 in a text is decoded as a space, as the
library does; round_trip is false there.  Repeated rows are each returned; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.storage import documents, map_arrow

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: What the library shows for an unknown piece.
UNKNOWN_MARK = " ⁇ ".encode()
MEMO, MEMO_LENGTH, PAIRS = 150_000, 64, 200_000


class _Memo(dict):
    """Unit -> ids as bytes, in two generations of at most MEMO short units."""

    def __init__(self, encoded: Callable[[str], bytes]) -> None:
        super().__init__()
        self._encoded = encoded
        self._older: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        found = self._older.get(unit) or self._encoded(unit)
        if len(unit) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self._older = dict(self)
                self.clear()
            self[unit] = found
        return found


class Pieces:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.names = {i: model.id_to_piece(i) for i in plain}
        self.ids = {s: i for i, s in self.names.items()}
        self.rank = {s: model.get_score(i) for i, s in self.names.items()}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in every if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.raw = [b""] * len(every)
        for i, s in self.names.items():
            self.raw[i] = s.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = UNKNOWN_MARK
        self.longest = max(map(len, self.ids))
        built = {s: list(self.merge(s)) for s in self.ids}
        self.whole = {s: i for s, i in self.ids.items() if len(built[s][-1][0]) == 1}
        #: Whether later merges of a piece never score higher than earlier ones.
        self.in_order = all(a[1] >= b[1] for s in self.whole for a, b in zip(built[s], built[s][1:], strict=False))
        self._ends: dict[int, dict[int, list[tuple[str, float]]]] = {0: {}, -1: {}}
        self.sizes = [0] * len(every)
        self.ending = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in self.whole.items():
            self.sizes[i] = len(s)
            self.ending.add_word(s, i)
        self.ending.make_automaton()
        crossing = any(MARK in s.lstrip(MARK) or "\n" in s for s in self.ids)
        self.units = re.compile("(?s).+" if crossing else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self._pairs: dict[int, bool] = {}
        self._memo = _Memo(lambda unit: b"".join([array("i", part).tobytes() for part in self.search(unit)]))

    def merge(self, text: str) -> Iterator[tuple[list[str], float]]:
        """BPE of a few characters: the symbols at first and after each merge, with its score.

        The best-ranked neighbours are joined first, the leftmost of equal ones.
        """
        parts, rank = list(text), self.rank
        yield parts, np.inf
        while len(parts) > 1:
            scores = [rank.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == -np.inf:
                break
            i = scores.index(best)
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
            yield parts, best

    def ends(self, piece: int, side: int) -> list[tuple[str, float]]:
        """The symbols at one end (0, -1) of a piece while BPE builds it, each with the score of the merge that takes it in."""
        found = self._ends[side].get(piece)
        if found is None:
            symbols, taken = [], []
            for parts, score in self.merge(self.names[piece]):
                if not symbols or parts[side] != symbols[-1]:
                    symbols.append(parts[side])
                    taken.append(score)
            found = self._ends[side][piece] = list(zip(symbols, [*taken[1:], -np.inf], strict=True))
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether two pieces in a row stay two pieces: no merge over their border comes before those within them."""
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self._stay(left, right) if self.in_order else list(self.merge(self.names[left] + self.names[right]))[-1][0] == [self.names[left], self.names[right]]
        return found

    def _stay(self, left: int, right: int) -> bool:
        ours, theirs = iter(self.ends(left, -1)), iter(self.ends(right, 0))
        (a, until_a), (b, until_b) = next(ours), next(theirs)
        while True:
            score = self.rank.get(a + b)
            if score is not None and score > until_a and score >= until_b:
                return False
            if until_a == until_b == -np.inf:
                return True
            if until_a >= until_b:
                a, until_a = next(ours)
            else:
                b, until_b = next(theirs)

    def search(self, text: str) -> Iterator[list[int]]:
        """Committed ids of one unit, part by part.

        last holds, for each position in the window, the piece that ends there, which is its backpointer too;
        a character without a piece is -1 less its code point.
        """
        at, last = 0, [-1]
        sizes, pairs, apart, longest = self.sizes, self._pairs.get, self.apart, self.longest
        for end, found in self.ending.iter(text):
            if end != at:
                if end < at:
                    continue
                last += [-1 - ord(c) for c in text[at:end]]
                at = end
            # the window is never shorter than a piece that may end here
            left = last[-sizes[found]]
            if left >= 0:
                fits = pairs(left << 32 | found)
                if fits is None:
                    fits = apart(left, found)
                if not fits:
                    continue
            last.append(found)
            at += 1
            if at % longest == 0 and len(last) > 2 * longest:
                joint = self._joint(last)
                if joint:
                    yield self._path(last, joint)
                    del last[:joint]
        last += [-1 - ord(c) for c in text[at:]]
        yield self._path(last, len(last) - 1)

    def _joint(self, last: list[int]) -> int:
        """The last position through which the paths to all positions that a later piece may begin at lead."""
        alive = set(range(len(last) - self.longest, len(last)))
        while len(alive) > 1:
            far = max(alive)
            alive.remove(far)
            alive.add(far - (self.sizes[last[far]] if last[far] >= 0 else 1))
        return alive.pop()

    def _path(self, last: list[int], at: int) -> list[int]:
        found: list[int] = []
        while at:
            piece = last[at]
            if piece >= 0:
                found.append(piece)
                at -= self.sizes[piece]
            else:
                found += [self.bytes.get(b, self.unknown) for b in reversed(chr(-1 - piece).encode("utf-8", "replace"))]
                at -= 1
        return found[::-1]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        return b"".join(map(self._memo.__getitem__, self.units.findall(MARK + text.replace(" ", MARK)))) if text else b""

    def decode(self, ids: list[int | None]) -> str | None:
        """The text of ids; None if one of them is no id of the vocabulary."""
        try:
            if ids and min(ids) < 0:
                return None
            raw = b"".join(map(self.raw.__getitem__, ids))
        except (IndexError, TypeError):
            return None
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_loaded: dict[str, Pieces] = {}


def pieces(name: str = MODEL) -> Pieces:
    """One model for each process and file."""
    if name not in _loaded:
        import public_tokenizers

        _loaded[name] = Pieces(public_tokenizers.path(name))
    return _loaded[name]


def encode(docs: DataFrame, keep: list[str] | None = None, text: str = "text", model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """The kept columns, n_pieces, ids_sha256 (of little-endian 32-bit ids), round_trip (decoding gives the text), and ids."""
    keep = keep or ["doc_id"]
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), "n_pieces long, ids_sha256 string, round_trip boolean", *["ids array<int>"] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
                raw = [p.encode(t) for t in texts]
                ids = [np.frombuffer(r, "<i4") for r in raw]
                cols = [pa.array([len(i) for i in ids], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()), pa.array([p.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)], pa.bool_())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=[*keep, "n_pieces", "ids_sha256", "round_trip", *["ids"] * with_ids])

    return map_arrow(source, run, schema)


def decode(encoded: DataFrame, keep: list[str] | None = None, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The kept columns and the text of the ids, in which an unknown piece is the library's mark; null ids, and ids outside of the vocabulary: null."""
    keep = keep or ["doc_id"]
    source = encoded.select(*keep, F.col(ids).alias("__ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__ids"), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([None if i.as_py() is None else p.decode(i.as_py()) for i in batch.column(len(keep))], pa.string())], names=[*keep, "text"])

    return map_arrow(source, run, schema)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), with_ids=False)
