"""Encoding of whole texts with a public byte-level BPE tokenizer, long texts in overlapping chunks."""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporlake.session import spread

#: Rank file of the tokenizer: base64 bytes and id a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of a chunk and of the overlap in which the pre-tokens of two chunks must meet again.
CHUNK, OVERLAP = 4096, 512
#: Chunks of one text that are pre-tokenised, and pieces that are encoded, at the same time.
THREADS = 4
#: Pre-tokens of byte-level BPE (fixed pattern of the tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRE = regex.compile(PATTERN)


@functools.lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file, without special tokens."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


def safe_ends(text: str, start: int, last: bool, lo: int = 0) -> list[int]:
    """Pre-token ends of a chunk, from place ``lo`` on, at which the text may be cut.

    A cut after white space would join or part a run of it, so only ends after another character count; a token
    close to the end of a chunk that isn't the last may be longer in truth.
    """
    limit = len(text) if last else len(text) - 3
    return [start + m.end() for m in _PRE.finditer(text, concurrent=True) if lo <= m.end() <= limit and not text[m.end() - 1].isspace()]


def stitch(chunks: list[tuple[int, str, list[int]]], length: int) -> list[int]:
    """Cuts of a text: the first ends that each two neighbouring chunks share past the start of the second.

    chunks: (start, text, safe ends) in order. Where two chunks don't meet again there is no cut between them.
    """
    cuts = []
    for (_, _, a), (start, _, b) in zip(chunks, chunks[1:], strict=False):
        shared = sorted(set(b).intersection(x for x in a if x > start))
        if shared and (not cuts or shared[0] > cuts[-1]) and shared[0] < length:
            cuts.append(shared[0])
    return cuts


def chunks_of(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    out, start = [], 0
    while True:
        out.append((start, text[start : start + chunk + overlap]))
        if start + chunk + overlap >= len(text):
            return out
        start += chunk


def pieces(text: str, chunk: int = CHUNK, overlap: int = OVERLAP, pool: ThreadPoolExecutor | None = None) -> list[str]:
    """The pieces of a text that may be encoded apart: its chunks are pre-tokenised apart and stitched."""
    parts = chunks_of(text, chunk, overlap)
    if len(parts) == 1:
        return [text]
    run = pool.map if pool else map
    ends = run(lambda k: safe_ends(parts[k][1], parts[k][0], k == len(parts) - 1), range(len(parts)))
    b = [0, *stitch([(s, x, e) for (s, x), e in zip(parts, ends, strict=True)], len(text)), len(text)]
    return [text[i:j] for i, j in zip(b[:-1], b[1:], strict=True)]


def _encode(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        with ThreadPoolExecutor(THREADS) as pool:
            for batch in batches:
                flat, ends = array("i"), array("i", [0])
                for t in batch.column(1).to_pylist():
                    if t and len(t) <= chunk + overlap:
                        flat.extend(enc.encode_ordinary(t))
                    elif t:
                        for e in enc.encode_ordinary_batch(pieces(t, chunk, overlap, pool), num_threads=THREADS):
                            flat.extend(e)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(np.frombuffer(ends, np.int32), np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    return run


def token_ids(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id`` and ids, the tokens of each text without special tokens; the strings of special tokens are ordinary text.

    Null and empty texts both give an empty list. Rows are kept as they are: repeated rows give repeated rows, a
    null id stays. Other columns aren't read. Long texts become overlapping chunks, which are pre-tokenised apart and
    at the same time; neighbouring chunks are cut where their pre-token ends first agree, and the pieces are encoded
    apart. A token longer than the overlap just leaves two pieces in one.

    One pass over the documents, nothing is joined or grouped: a text is one value of one row, so the task that reads
    it holds it anyway, and its chunks run on the task's threads.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t"))
    out = spread(rows).mapInArrow(_encode(path, chunk, overlap), "id long, ids array<int>")
    return out.select(F.col("id").alias(id), "ids")


@functools.lru_cache(maxsize=2)
def _bytes_of_tokens(path: str) -> dict[int, bytes]:
    return {i: b for b, i in _ranks(path).items()}


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text of ids: their raw bytes one after the other."""
    table = _bytes_of_tokens(path)
    return b"".join(table[i] for i in ids).decode("utf-8", errors="replace")
