"""Operator 1, token counts: whole words of the vocabulary are counted directly, only the rest is merged.

The driver proves once which vocabulary strings encode alone as one token; that set is bounded by the
vocabulary and is broadcast.  A task cuts each text into pre-tokens; those in the set count as one, any
other is merged by the model once and its count remembered in a bounded memo.

Cases.  Null and empty text: no tokens, 0 bytes.  Very long texts are counted whole.  Special strings
inside a text count as one token each, as is the library's default.  Repeated rows are each returned; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.storage import documents, map_arrow

#: Fixed values of this tokenizer's file format: the visible characters that stand for themselves among the 256 byte symbols.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
MEMO, MEMO_LENGTH = 300_000, 64
OVER = 2048
#: Characters from which on a text's pre-tokens aren't listed all at once.
LONG = 1 << 20
#: Characters that the library treats by newer Unicode tables than Python's (found by trying all of them): texts with one are counted by the library.
NEWER = regex.compile("[\ua7cb\ua7dc\U00032808\U0003285c\U00032988\U0003d808\U0003d85c\U0003d988\U0003e808\U0003e85c\U0003e988\U0003f808\U0003f85c\U0003f988]")


def byte_symbols() -> dict[int, str]:
    """Byte -> symbol; bytes that don't stand for themselves follow from U+0100 on."""
    rest = [b for b in range(256) if b not in set(_SELF)]
    return {b: chr(b) for b in _SELF} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def lower(text: str) -> str:
    """Lower case character by character: a sigma at a word's end isn't special."""
    return text.replace("Σ", "σ").lower()


class Counter:
    """Counts tokens of texts under one word-level BPE file."""

    def __init__(self, path: str, whole: frozenset[str] | None = None) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        self._vocab = spec["model"]["vocab"]
        self._suffix = spec["model"]["end_of_word_suffix"]
        special = [t["content"] for t in spec["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self._marks = tuple(special)
        self._pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._symbols = byte_symbols()
        self.whole = self._prove() if whole is None else whole
        self._memo = _Memo(self)

    def merged(self, piece: str) -> int:
        return len(self._model.tokenize("".join(map(self._symbols.__getitem__, piece.encode()))))

    def _prove(self) -> frozenset[str]:
        """The vocabulary strings that are one pre-token and encode alone as one token."""
        back = {s: b for b, s in self._symbols.items()}
        found = set()
        for entry in self._vocab:
            if entry.endswith(self._suffix) and len(entry) > len(self._suffix):
                try:
                    text = bytes(back[c] for c in entry.removesuffix(self._suffix)).decode()
                except (UnicodeDecodeError, KeyError):
                    continue
                if self._pieces.findall(text) == [text] and self.merged(text) == 1:
                    found.add(text)
        return frozenset(found)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if any(m in text for m in self._marks):
            parts = self._special.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        if not text.isascii():
            if NEWER.search(text):
                return len(self._library.encode(text, add_special_tokens=False).ids)
            text = unicodedata.normalize("NFC", text)
        return sum(self._memo[m[0]] for m in self._pieces.finditer(lower(text))) if len(text) > LONG else sum(map(self._memo.__getitem__, self._pieces.findall(lower(text))))


class _Memo(dict):
    """Pre-token -> tokens; whole tokens are there from the start, and at most MEMO short others."""

    def __init__(self, counter: Counter) -> None:
        super().__init__(dict.fromkeys(counter.whole, 1))
        self._counter = counter

    def __missing__(self, piece: str) -> int:
        n = self._counter.merged(piece)
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO + len(self._counter.whole):
                self.clear()
                self.update(dict.fromkeys(self._counter.whole, 1))
            self[piece] = n
        return n


_counters: dict[str, Counter] = {}


def counter(name: str, whole: Callable[[], frozenset[str]] | None = None) -> Counter:
    """One counter for each process and tokenizer file."""
    if name not in _counters:
        import public_tokenizers

        _counters[name] = Counter(public_tokenizers.path(name), whole() if whole else None)
    return _counters[name]


def count_tokens(docs: DataFrame, keep: list[str] | None = None, text: str = "text", tokenizer: str = "word_bpe_49k.json", over: int = OVER) -> DataFrame:
    """The kept columns, n_bytes, n_tokens and over_limit of each row."""
    keep = keep or ["doc_id"]
    source = docs.select(*keep, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), "n_tokens long", "over_limit boolean"])
    whole = docs.sparkSession.sparkContext.broadcast(counter(tokenizer).whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, lambda: whole.value).count
        for batch in batches:
            n = [count(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array([x > over for x in n], pa.bool_())], names=[*batch.schema.names[:-1], "n_tokens", "over_limit"])

    return map_arrow(source, run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
