"""Encoding texts with a public tokenizer's byte-level BPE, with offsets, and decoding.

The tokenizer's file is a parameter and is read by each Python worker once. Batches stay Arrow: texts go to the library as they are, ids come back
as one flat array with offsets.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the public tokenizers' files, and the file used by default.
FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"

#: So many characters go to the library at once, so that its results' memory is bounded whatever the batch.
CHARS_AT_ONCE = 2_000_000


def tokenizer_path(name: str = BYTE_BPE) -> str:
    return os.path.join(FOLDER, name)


@functools.lru_cache(maxsize=4)
def load(path: str):  # noqa: ANN201
    """The tokenizer, reading special tokens' strings as plain text. One per process; Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=1)
def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the other bytes, in
    order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; ids of the vocabulary without an entry, and special tokens, have their string's."""
    to_byte = byte_of_char()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    table: dict[int, bytes] = {i: bytes(to_byte[c] for c in s) for s, i in model["model"]["vocab"].items() if all(c in to_byte for c in s)}
    table |= {x["id"]: x["content"].encode() for x in model.get("added_tokens", [])}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def decode(ids: list[int], path: str) -> str:
    """The text of ids. A character whose bytes are split over tokens is whole again; bytes that are no UTF-8 become U+FFFD."""
    table = token_bytes(path)
    return b"".join(table[i] for i in ids).decode("utf-8", errors="replace")


def character_offsets(text: str, ids: list[int], path: str) -> tuple[list[int], list[int]]:
    """First character and end of each token, from the tokens' bytes. A token with only part of a character's bytes covers that character."""
    table = token_bytes(path)
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    starts = (raw & 0xC0) != 0x80
    char_of = np.cumsum(starts) - 1  # the character that each byte belongs to
    ends = np.cumsum([len(table[i]) for i in ids])
    begins = ends - np.array([len(table[i]) for i in ids]) if len(ids) else ends
    if not len(ids):
        return [], []
    return char_of[begins].tolist(), (char_of[ends - 1] + 1).tolist()


#: A text splits exactly before white space that follows something else: the pattern of the byte-level pre-tokenizer never joins across.
_WORD = re.compile(r"\s*\S+|\s+")
#: White space to Python but not to Unicode: a text that holds any isn't split.
_ODD = re.compile("[\x1c-\x1f]")
#: Fixed value: the pre-tokenizer's pattern, for ASCII.
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Characters held by a memo before it starts anew.
_MEMO_CHARS = 16_000_000


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> bool:
    """Whether the file's tokenizer takes texts as they are and splits them by the byte-level pattern above: only then do words stand for themselves."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre = said.get("pre_tokenizer") or {}
    return not said.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)


class Memo:
    """Ids of pieces that the library has encoded before, as identifiers and code repeat. Exact: the pieces are those that the pre-tokenizer separates anyway,
    in text that isn't ASCII whole words of them."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.by_pieces = load(path), byte_level(path)
        self.ids: dict[str, list[int]] = {}
        self.chars = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for low, high in _groups(texts) for e in self.tokenizer.encode_batch_fast(texts[low:high], add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[array, list[int]]:
        """Flat ids, and how many each text has. A tokenizer of another kind than the byte-level one gets texts whole."""
        if not self.by_pieces:
            found = self._library(texts)
            return array("i", chain.from_iterable(found)), list(map(len, found))
        if self.chars > _MEMO_CHARS:
            self.ids, self.chars = {}, 0
        split = list(map(_pieces, texts))
        new = list(set().union(*split) - self.ids.keys())
        self.ids.update(zip(new, self._library(new), strict=True))
        self.chars += sum(map(len, new))
        of, flat, lengths = self.ids.__getitem__, array("i"), []
        for pieces in split:
            before = len(flat)
            flat.extend(chain.from_iterable(map(of, pieces)))
            lengths.append(len(flat) - before)
        return flat, lengths


def _pieces(text: str) -> list[str]:
    """Parts of a text that are encoded apart."""
    if text.isascii():
        return _ASCII_PIECE.findall(text)
    if _ODD.search(text):
        return [text]
    out: list[str] = []
    for w in _WORD.findall(text):
        if w.isascii():
            out += _ASCII_PIECE.findall(w)
        else:
            out.append(w)
    return out


@functools.lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    return Memo(path)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHARS_AT_ONCE characters; a longer text is a range of its own."""
    low = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHARS_AT_ONCE:
            yield low, i
            low, held = i, 0
        held += len(t)
    if low < len(texts):
        yield low, len(texts)


def encode_batch(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and row offsets; null and empty texts have none."""
    known, memo = [t or "" for t in texts], _memo(path)
    flat, lengths = array("i"), []
    collecting = gc.isenabled()
    gc.disable()  # the many small lists hold no cycles, and looking for some takes a sixth of the time
    try:
        for low, high in _groups(known):
            ids, n = memo.encode(known[low:high])
            flat.extend(ids)
            lengths += n
    finally:
        if collecting:
            gc.enable()
    return np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)


def _add(df: DataFrame, text: str, fields: list[T.StructField], make) -> DataFrame:  # noqa: ANN001
    """`df` with columns that `make(list of texts)` gives as Arrow arrays."""
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Ids take about as much room as their text: small outgoing batches keep the JVM's copies small.
            for low in range(0, b.num_rows, 2_000):
                part = b.slice(low, 2_000)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(at).to_pylist())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """`df` with `ids`, the token ids of `text` without special tokens (their strings are plain text). Null and empty texts give an empty list.

    Select the columns to keep before; they pass through Python. Raises if `ids` is a column already.
    """
    path = path or tokenizer_path()
    _new(df, ids)

    def make(texts: list[str | None]) -> list[pa.Array]:
        flat, offsets = encode_batch(texts, path)
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]

    return _add(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def encode_with_offsets(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """`df` with `ids`, and `starts` and `ends`: the characters (code points) that each token covers. A character split over tokens is covered by each."""
    path = path or tokenizer_path()
    _new(df, "ids", "starts", "ends")
    if not byte_level(path):
        raise ValueError("offsets come from the tokens' bytes, which only a byte-level tokenizer without normaliser keeps")

    def make(texts: list[str | None]) -> list[pa.Array]:
        flat, offsets = encode_batch(texts, path)
        spans = [character_offsets(t or "", flat[a:b].tolist(), path) for t, a, b in zip(texts, offsets, offsets[1:], strict=False)]
        rows = pa.array(offsets, pa.int32())
        return [pa.ListArray.from_arrays(rows, pa.array(x, pa.int32())) for x in (flat, [i for s, _ in spans for i in s], [i for _, e in spans for i in e])]

    lists = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "ends")]
    return _add(df, text, lists, make)


def decoded(df: DataFrame, ids: str = "ids", path: str | None = None, text: str = "decoded") -> DataFrame:
    """`df` with the text of `ids`; a null list gives null."""
    path = path or tokenizer_path()
    _new(df, text)
    return _add(df, ids, [T.StructField(text, T.StringType())], lambda rows: [pa.array([None if r is None else decode(r, path) for r in rows], pa.string())])


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """`df` without `text` but with its number of tokens, 0 for null and empty."""
    path = path or tokenizer_path()
    _new(df, name)

    def make(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(np.diff(encode_batch(texts, path)[1]), pa.int32())]

    return _add(df, text, [T.StructField(name, T.IntegerType())], make).drop(text)


def _new(df: DataFrame, *names: str) -> None:
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has the columns {sorted(clash)} already; rename them first")
