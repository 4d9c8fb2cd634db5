"""Encoding with a public byte-level tokenizer through a tokenization automaton.

The merges are compiled in rank order. The automaton has one state per token (the token read last); merge ``(a, b) -> c`` adds
one gadget: the new state ``c`` copies the arcs that leave ``b``, every state with an arc to ``a`` gets one to ``c``, and the
arc from ``a`` to ``b`` goes away (for ``a = b`` the state ``a`` gets no arc to ``c``, as runs are merged from the left).
A path is then the one sequence of tokens that the merges give for its bytes. The gadgets are kept as three tables (row copied
from, column copied from, rank at which an arc went away); an arc is read from them on its first use and kept in a transition
table, so the |V| x |V| table is never laid out. Words are encoded left to right: every prefix of a word has exactly one path,
so one token per position suffices, and the time is linear in the length even of a word without any blank.
"""

from __future__ import annotations

import importlib.util
import json
import os
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "byte_bpe_50k"
#: Fixed value: the published pre-split pattern of this tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS_KEPT = 400_000
ARCS_KEPT = 4_000_000


def default_folder() -> str:
    """Folder of the vocabulary files: ``PUBLIC_TOKENIZERS``, else that of the installed package, else its usual place."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS"):
        return folder
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def byte_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Deterministic tokenization automaton of one merge list."""

    def __init__(self, folder: str | None = None, name: str = TOKENIZER):
        with open(os.path.join(folder or default_folder(), f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.label: dict[int, bytes] = {}
        for text, i in vocab.items():
            if all(c in letters for c in text):
                self.label[i] = bytes(letters[c] for c in text)
        size = max(vocab.values()) + 1
        #: The gadget of each state: row copied from (right part), column copied from (left part), and when it was added.
        self.row_from, self.column_from, self.born = array("i", [-1] * size), array("i", [-1] * size), array("i", [-1] * size)
        self.removed: dict[int, int] = {}
        self.size = size
        built = {vocab[c]: -1 for c in letters if c in vocab}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.removed[a * size + b] = rank
            if c not in built:
                built[c] = rank
                self.row_from[c], self.column_from[c], self.born[c] = b, a, rank
        self.arcs: dict[int, bool] = {}
        self.trie: list = [{}, -1]
        for i in built:
            node = self.trie
            for byte in self.label[i]:
                node = node[0].setdefault(byte, [{}, -1])
            node[1] = i
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall

    def _gadget(self, p: int, q: int, before: int) -> bool:
        """Whether the arc from state p to state q is there once all gadgets of a rank below ``before`` are in place."""
        while True:
            if self.removed.get(p * self.size + q, before) < before:
                return False
            born_p, born_q = self.born[p], self.born[q]
            if born_p < 0 and born_q < 0:
                return True
            if born_p == born_q:
                # c = (a, a) after itself, or (a, b) after itself: read q as its left part just before both were added
                p, q, before = self.row_from[p], self.column_from[q], born_p
                continue
            if born_p > born_q:
                p, before = self.row_from[p], born_p
                if self.removed.get(p * self.size + q, before) < before:
                    return False
            else:
                left = self.column_from[q]
                if left == self.row_from[q] == p:
                    return False
                q, before = left, born_q

    def arc(self, p: int, q: int) -> bool:
        key = p * self.size + q
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= ARCS_KEPT:
                self.arcs.clear()
            known = self.arcs[key] = self._gadget(p, q, 1 << 30)
        return known

    def encode_bytes(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pre-split word."""
        n = len(word)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            if i and last[i] < 0:
                continue
            node, before = self.trie, last[i]
            for j in range(i, n):
                node = node[0].get(word[j])
                if node is None:
                    break
                token = node[1]
                if token >= 0 and (i == 0 or self.arc(before, token)):
                    last[j + 1], start[j + 1] = token, i
        ids, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError("no path: the vocabulary lacks a byte")
            ids.append(last[at])
            at = start[at]
        return tuple(reversed(ids))

    def encode(self, text: str | None, out: array | None = None) -> array:
        """Ids of a text without special tokens; none for an empty or null text."""
        out = array("i") if out is None else out
        if text:
            words, extend = self.words, out.extend
            for word in self.split(text):
                ids = words.get(word)
                if ids is None:
                    if len(words) >= WORDS_KEPT:
                        words.clear()
                    ids = self.encode_bytes(word.encode("utf-8", "surrogatepass"))
                    if len(word) <= 64:
                        words[word] = ids
                extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: the labels of the arcs, one after the other."""
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")


_automata: dict[tuple, Automaton] = {}


def automaton(folder: str | None = None, name: str = TOKENIZER) -> Automaton:
    """One automaton per worker process."""
    if (folder, name) not in _automata:
        _automata[folder, name] = Automaton(folder, name)
    return _automata[folder, name]


def _appended(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema if f.name != name] + [T.StructField(name, kind)])


def with_token_ids(docs: DataFrame, text: str = "text", ids: str = "ids", folder: str | None = None, name: str = TOKENIZER) -> DataFrame:
    """All rows and columns, and ``ids array<int>``: the ids of the whole text, an empty list for an empty or null text.

    Narrow, one pass; a column already called ``ids`` is replaced; repeated rows stay; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(folder, name)
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                a.encode(value, flat)
                offsets.append(len(flat))
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            kept = [i for i, n in enumerate(batch.schema.names) if n != ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), column], names=[*(batch.schema.names[i] for i in kept), ids])

    return docs.mapInArrow(run, _appended(docs.schema, ids, T.ArrayType(T.IntegerType())))


def with_token_count(docs: DataFrame, text: str = "text", count: str = "tokens", folder: str | None = None, name: str = TOKENIZER) -> DataFrame:
    """All rows and columns, and ``tokens bigint``: the number of ids of the text, 0 for an empty or null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(folder, name)
        for batch in batches:
            sizes = [len(a.encode(v)) for v in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            kept = [i for i, n in enumerate(batch.schema.names) if n != count]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sizes, pa.int64())], names=[*(batch.schema.names[i] for i in kept), count])

    return docs.mapInArrow(run, _appended(docs.schema, count, T.LongType()))


def decode_ids(rows: DataFrame, ids: str = "ids", text: str = "decoded", folder: str | None = None, name: str = TOKENIZER) -> DataFrame:
    """All rows and columns, and the text of the ids; null ids give an empty text."""

    @F.pandas_udf(T.StringType())
    def decode(values):  # type: ignore[no-untyped-def]
        a = automaton(folder, name)
        return values.map(lambda v: "" if v is None else a.decode(int(i) for i in v))

    return rows.withColumn(text, decode(F.col(f"`{ids}`")))
