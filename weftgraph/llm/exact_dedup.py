"""Exact dedup by counting quotient filters, with byte verification.

Method.  Every text (A-Z lower-cased, UTF-8) has a 64-bit fingerprint, split
into a quotient (top bits) and a remainder.  Each partition builds a counting
quotient filter: per occupied quotient a run of sorted remainders with counts.
Filters are cut by leading quotient bits, and equal cuts merge losslessly by
their sorted remainders, adding counts; the number of cuts follows the number
of rows, so that a merge holds a bounded share.  A hot text is one counted
entry of each filter.  Fingerprints with a merged count above one route their
rows to byte verification: grouping by the whole text, equal texts combined
before they are shuffled.  Rows of all other fingerprints are unique as they are.

Defined results: null text counts as empty; the row with the largest doc_id of
equal texts stays (null ids are least); rows that repeat both doc_id and text
carry the same decision; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import materialise, sifted, told_apart, without

REMAINDERS_PER_CUT = 1 << 16


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z alone lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def fingerprint(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


class CountingQuotientFilter:
    """Sorted occupied quotients, their run lengths, and the remainders of each
    run in order with counts.  Equality of filters is equality of multisets."""

    def __init__(self, quotient_bits: int, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotient_bits, self.quotients, self.runs, self.remainders, self.counts = quotient_bits, quotients, runs, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, quotient_bits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        fp = fingerprints[order]
        weight = np.ones(len(fp), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]])) if len(fp) else np.zeros(0, np.int64)
        fp, weight = fp[first], np.add.reduceat(weight, first) if len(fp) else weight
        shift = np.uint64(64 - quotient_bits)
        quotients, runs = np.unique((fp >> shift).astype(np.int64), return_counts=True)
        return cls(quotient_bits, quotients, runs, (fp & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.uint64), weight)

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients, self.runs).astype(np.uint64) << np.uint64(64 - self.quotient_bits)) | self.remainders

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless: runs of one quotient merge by their sorted remainders, counts add up."""
        return cls.build(np.concatenate([f.fingerprints() for f in filters]), filters[0].quotient_bits, np.concatenate([f.counts for f in filters]))

    def cuts(self, cut_bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter, cut by its leading quotient bits."""
        cut = self.quotients >> (self.quotient_bits - cut_bits)
        ends = np.concatenate([[0], np.cumsum(self.runs)])
        edges = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1], [True]])) if len(cut) else np.zeros(0, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = slice(ends[a], ends[b])
            yield int(cut[a]), CountingQuotientFilter(self.quotient_bits, self.quotients[a:b], self.runs[a:b], self.remainders[part], self.counts[part])


_FILTER = "cut int, quotients array<long>, runs array<long>, remainders array<long>, counts array<long>"


def filters(fingerprints: DataFrame, quotient_bits: int, cut_bits: int) -> DataFrame:
    """One filter a partition of column ``fp``, a row for each of its cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[CountingQuotientFilter] = []
        for batch in batches:
            held.append(CountingQuotientFilter.build(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), quotient_bits))
            if len(held) >= 16:
                held = [CountingQuotientFilter.merge(held)]
        if not held:
            return
        rows = list(CountingQuotientFilter.merge(held).cuts(cut_bits))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _ in rows], pa.int32()),
                *(pa.array([x for _, f in rows for x in [getattr(f, name)]], pa.list_(pa.int64())) for name in ("quotients", "runs")),
                pa.array([f.remainders.view(np.int64) for _, f in rows], pa.list_(pa.int64())),
                pa.array([f.counts for _, f in rows], pa.list_(pa.int64())),
            ],
            names=["cut", "quotients", "runs", "remainders", "counts"],
        )

    return fingerprints.select("fp").mapInArrow(run, _FILTER)


def merged_repeats(parts: DataFrame, quotient_bits: int) -> DataFrame:
    """(fp, n): fingerprints whose count over all merged filters is above one."""

    def run(table: pa.Table) -> pa.Table:
        columns = {name: table.column(name).to_pylist() for name in ("quotients", "runs", "remainders", "counts")}
        held = [
            CountingQuotientFilter(quotient_bits, np.array(q, np.int64), np.array(r, np.int64), np.array(m, np.int64).view(np.uint64), np.array(c, np.int64))
            for q, r, m, c in zip(*columns.values(), strict=True)
        ]
        whole = CountingQuotientFilter.merge(held)
        again = whole.counts > 1
        return pa.table({"fp": whole.fingerprints()[again].view(np.int64), "n": whole.counts[again]})

    return parts.groupBy("cut").applyInArrow(run, "fp long, n long")


def _digests(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [normalised(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _signed([fingerprint(x) for x in data]), pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())],
                names=["doc_id", "fp", "text_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, fp long, text_sha256 string")


def _order(key) -> tuple:
    """Order of ids in Python as Spark orders them: nulls first, structs by their fields."""
    return tuple(map(_order, key.values())) if isinstance(key, dict) else (key is not None, key)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, data, copies): equal texts of a batch as one row, with the largest id, so
    that a hot text is a row for each batch when it meets its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list] = {}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = held.setdefault(normalised(text), [key, 0])
                found[1] += 1
                if _order(key) > _order(found[0]):
                    found[0] = key
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key for key, _ in held.values()], batch.column(0).type),
                    _signed([fingerprint(x) for x in held]),
                    pa.array(list(held), pa.binary()),
                    pa.array([n for _, n in held.values()], pa.int64()),
                ],
                names=["doc_id", "fp", "data", "copies"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, fp long, data binary, copies long")


def _routed(texts: DataFrame, repeats: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose fingerprint is one of ``repeats``: most unique texts are dropped where
    they are read, and the exact join then shuffles what passed."""
    return sifted(texts, repeats).join(repeats.select("fp"), "fp")


def exact_groups(docs: DataFrame, remainders_per_cut: int = REMAINDERS_PER_CUT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each input row."""
    docs = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    rows = materialise(_digests(docs))
    n = rows.count()
    cut_bits = max(6, (n // remainders_per_cut).bit_length())
    quotient_bits = max(cut_bits, min(48, n.bit_length()))
    repeats = materialise(merged_repeats(filters(rows, quotient_bits, cut_bits), quotient_bits))
    # byte verification of the routed rows: the grouping key is the whole text
    verified = (
        _routed(_texts(docs), repeats)
        .groupBy("data")
        .agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2("data", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    found = rows.join(verified, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one of each group, also where rows repeat id and text."""
    found = materialise(exact_groups(told_apart(docs, nulls_first=True)).filter("group_size > 1").select("doc_id", "kept"))
    repeated = found.filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return without(docs, found.filter("not kept"), repeated)
