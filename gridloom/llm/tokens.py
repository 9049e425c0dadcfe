"""Token ids of whole texts by a public tokenizer's local rank file (problem 8)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie on every machine.
FOLDER = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Fixed value: the pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are cut into parts of about this many characters; runs of blanks from LONG_BLANK on are encoded by themselves.
PART, LONG_BLANK = 16_384, 1_024
_ROWS = 256

_BLANKS = regex.compile(r"[ \t\r\n]{%d,}" % LONG_BLANK)
# No token reaches over these: a letter, digit or ASCII sign before a blank, a letter before a digit. What stands
# before such a place is split alike without what follows, and the pattern never looks back.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}!-~])(?=[ \t\r\n])|(?<=[A-Za-z])(?=[0-9])")


@lru_cache(maxsize=4)
def encoding(folder: str = FOLDER, name: str = TOKENIZER) -> tiktoken.Encoding:
    """The tokenizer of a rank file, made once per process."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text that can be encoded one by one; True: a run of blanks that is one piece before the merges."""
    at = 0
    for run in _BLANKS.finditer(text):
        # The last blank of a run goes with what follows; other kinds of blanks beside the run belong to it.
        start, stop = run.start(), run.end()
        while start > at and text[start - 1].isspace():
            start -= 1
        while stop < len(text) and text[stop].isspace():
            stop += 1
        if start < at:
            continue
        if stop < len(text):
            stop -= 1
        yield from _cut(text, at, start)
        yield text[start:stop], True
        at = stop
    yield from _cut(text, at, len(text))


def _cut(text: str, at: int, stop: int) -> Iterator[tuple[str, bool]]:
    while stop - at > PART:
        place = _SAFE.search(text, at + PART, stop)
        if place is None or place.start() >= stop:
            break
        yield text[at : place.start()], False
        at = place.start()
    if at < stop:
        yield text[at:stop], False


def encode(text: str | None, e: tiktoken.Encoding) -> list[int]:
    """Ids without special tokens; none for a null or empty text. Special tokens' strings are ordinary text."""
    if not text:
        return []
    if len(text) <= LONG_BLANK:
        return e.encode_ordinary(text)
    if len(text) <= PART and _BLANKS.search(text) is None:
        return e.encode_ordinary(text)
    ids: list[int] = []
    for part, blank in parts(text):
        ids += e._core_bpe.encode_single_piece(part.encode()) if blank else e.encode_ordinary(part)
    return ids


def decode(ids: list[int], e: tiktoken.Encoding) -> str:
    """The text of ids, joined as raw bytes first, as one character may be spread over several tokens."""
    return e.decode_bytes(ids).decode("utf-8", errors="strict")


def _lists(texts: list[str | None], e: tiktoken.Encoding) -> pa.ListArray:
    ids = [encode(t, e) for t in texts]
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=ends[1:])
    flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = TOKENIZER) -> DataFrame:
    """One row per document: key, ids (array of int). Null and empty texts both give an empty list.

    Bytes that are no UTF-8 count as U+FFFD, as Spark makes them.

    Repeated rows each give a row; an empty table gives none. Only key and text are read, nothing is shuffled.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(folder, name)
        for b in batches:
            for i in range(0, b.num_rows, _ROWS):
                s = b.slice(i, _ROWS)
                yield pa.RecordBatch.from_arrays([s.column(0), _lists(s.column(1).to_pylist(), e)], ["key", "ids"])

    return documents.select(key, F.make_valid_utf8(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", folder: str = FOLDER, name: str = TOKENIZER) -> DataFrame:
    """`keep` and n_tokens (bigint, 0 for null and empty texts) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(folder, name)
        for b in batches:
            n = [len(encode(t, e)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    fields = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return documents.select(*keep, F.make_valid_utf8(text).alias("a text")).mapInArrow(run, f"{fields}, n_tokens bigint")


def token_texts(ids: DataFrame, key: str = "doc_id", folder: str = FOLDER, name: str = TOKENIZER) -> DataFrame:
    """The way back: key, text of rows (key, ids). A null or empty list gives the empty text."""
    kind = ids.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(folder, name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(x or [], e) for x in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    return ids.select(key, "ids").mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
