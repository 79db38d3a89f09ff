"""Packing token streams into fixed windows by the online sum-of-squares rule.

Each task keeps a level array ``counts[h]`` = number of partly filled windows
holding ``h`` tokens.  A document first yields whole windows; its remainder of
``r`` tokens goes to the fill level ``h`` (0 opens a window) for which the sum
of squared counts after the move is least, ties to the fullest.  A full window
leaves at once, so only the open windows are held.  At the end of a task the
open windows stay as the rule put them, padded, unless they are filled to less
than ``least_fill``: the tokens of those few are cut anew into whole windows,
and what is left over at powers of two, which need no padding.  Tasks pack on
their own and nothing is shuffled; the share of padding falls as tasks grow,
since what is open at their ends grows more slowly than what they pack.

``max_open`` bounds the memory of a task and thereby changes where documents go:
past it, the fullest open window leaves as it is.

Ids are those of the public library with its default setting: a text is split at the
added tokens of the ranks' JSON file, each of which is one id.

Defined results: null text counts as empty (its one token is the end id);
texts of any length are cut; repeated rows are packed as separate documents;
a null doc_id is carried along.  An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftgraph.llm.bpe import BpeEncoder, encoder, slices

COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class SumOfSquaresPacker:
    """Online packer of one task; pieces are (key, start, ids, doc_tokens)."""

    def __init__(self, window: int = 1024, max_open: int = 4096, first_sequence: int = 0, least_fill: float = 0.75):
        self.window, self.max_open, self.sequence, self.least_fill = window, max_open, first_sequence, least_fill
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.done: list[tuple] = []  # (key, start, length, crc, doc_tokens, sequence, offset)
        self.by_rule = self.cut_anew = 0  # windows with a remainder, by what filled them

    def level(self, size: int) -> int:
        """Fill level for a remainder of ``size`` tokens (0: a new window)."""
        c, w = self.counts, self.window
        top = w - size
        change = 2 * (c[size:] - c[: top + 1] + 1)  # of the sum of squares, moving h -> h + size
        change[top] = 1 - 2 * c[top] if top else 0  # a full window is no longer counted
        change[0] = 2 * c[size] + 1 if top else 0
        usable = c[: top + 1] > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return top - int(np.argmin(change[::-1]))

    def add(self, key, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n - n % w
        for start in range(0, whole, w):
            self._emit([(key, start, ids[start : start + w], n)])
        if whole == n:
            return
        size = n - whole
        h = self.level(size)
        pieces = self.open[h].pop() if h else []
        if h:
            self.counts[h] -= 1
        pieces.append((key, whole, ids[whole:], n))
        if h + size == w:
            self._leave(pieces)
        else:
            self.open[h + size].append(pieces)
            self.counts[h + size] += 1
            if self.counts.sum() > self.max_open:
                fullest = int(np.flatnonzero(self.counts)[-1])
                self.counts[fullest] -= 1
                self._leave(self.open[fullest].pop(0))

    def close(self) -> None:
        """Well-filled windows leave as they are; the rest is cut anew: whole windows, then powers of two."""
        least = int(np.ceil(self.least_fill * self.window))
        for level in self.open[least:]:
            for pieces in level:
                self._leave(pieces)
        pieces = [p for level in reversed(self.open[:least]) for window in level for p in window]
        left = sum(len(p[2]) for p in pieces)
        self.open = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        room, held = min(self.window, 1 << max(left.bit_length() - 1, 0)), []
        for key, start, ids, n in pieces:
            while len(ids):
                part = ids[:room]
                held.append((key, start, part, n))
                start, ids, room, left = start + len(part), ids[len(part) :], room - len(part), left - len(part)
                if not room:
                    self._emit(held)
                    self.cut_anew += 1
                    room, held = min(self.window, 1 << max(left.bit_length() - 1, 0)), []

    def _leave(self, pieces: list[tuple]) -> None:
        self.by_rule += 1
        self._emit(pieces)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, n in pieces:
            self.done.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1


def added_tokens(ranks_path: str) -> dict[str, int]:
    """Ids of the added tokens, from the JSON file beside the ranks."""
    with open(ranks_path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def encode_with_added(enc: BpeEncoder, texts: list[str], added: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode_batch``, but with texts split at the added tokens."""
    if not any(token in t for token in added for t in texts):
        return enc.encode_batch(texts)
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    parts = [pattern.split(t) for t in texts]  # text, token, text, ... text
    ids, counts = enc.encode_batch([p for own in parts for p in own[::2]])
    tokens = np.array([added[p] for own in parts for p in own[1::2]], np.int32)
    pieces = np.array([len(own[::2]) for own in parts])
    last = np.cumsum(pieces) - 1
    inner = np.ones(len(counts), bool)
    inner[last] = False  # a token follows every piece but the last of a text
    ends = np.cumsum(counts)
    return np.insert(ids, ends[inner], tokens), np.add.reduceat(counts + inner, last - pieces + 1)


def pack(docs: DataFrame, ranks_path: str, window: int = 1024, end_id: int = 0, max_open: int = 4096, least_fill: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A sequence id is unique in the result: the task's number and a count."""
    kind = docs.schema[id_col].dataType.simpleString()
    added = added_tokens(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        context = TaskContext.get()
        packer = SumOfSquaresPacker(window, max_open, (context.partitionId() if context else 0) << 40, least_fill)
        id_type = None

        def flush() -> pa.RecordBatch:
            rows, packer.done = packer.done, []
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["id", *COLUMNS]
            )

        for batch in batches:
            id_type = batch.column(0).type
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids, counts = encode_with_added(enc, texts[a:b], added)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                at = 0
                for key, end in zip(keys[a:b], (ends + np.arange(1, b - a + 1)).tolist(), strict=True):
                    packer.add(key, ids[at:end])
                    at = end
                if packer.done:
                    yield flush()
        packer.close()
        if packer.done:
            yield flush()

    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS)
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
