"""Language-model scoring by cross-entropy difference.

Method.  Texts become tokens of the full byte-level BPE (every text can be written in
it, so nothing is unknown), and n-grams of orders 1 to 3, with marks for the beginning
of a text, are counted over all background and all target texts.  Both models share
vocabulary, orders and smoothing: they interpolate the orders with a Dirichlet prior
each: p(x | h) = (n(h x) + PRIOR * p(x | shorter h)) / (n(h) + PRIOR), add-one at
order 1.  A document's score is the mean over its tokens of target loss minus
background loss: the lower, the closer to the target.

Where the documents scored are the background itself, each is scored by the counts of
all the others (its own are taken off), as the target's model has not seen it either.
``background_weight`` scales the background's counts: with the target's share of all
tokens, both models smooth as if they had been learnt from texts of one size; 1, the
default, uses all that the background holds.

The table of n-grams is distributed and grows with the input; nothing of it meets
the driver.  Documents are read in slices of about ``SLICE`` characters; a slice
sends each n-gram it holds once, with its counts, to the bucket of the n-gram's
hash; a bucket adds up and answers every slice with the counts of the n-grams it
asked for; the slice scores its documents with them.  A frequent n-gram is one
entry a slice, and the number of buckets follows the size of the input, so that
slices and buckets stay of bounded size.

Defined results: null text counts as empty; a text without tokens has null
losses and a null score; an empty target or background gives uniform losses;
repeated rows have equal scores, and of each the others count; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.bpe import encoder, slices

ORDER = 3
PRIOR = 4.0
SLICE = 1 << 22
_START = 0xFFFF  # beginning of a text


class NgramSlice:
    """Distinct n-grams of some texts, by order from ``ORDER`` down to 0, with their counts.

    A key holds 16 bits a token below its order.  ``events`` counts an n-gram,
    ``histories`` how often a token follows it; ``lower`` and ``context`` point from each
    n-gram to the one without its first and the one without its last token."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        padded = np.full(len(ids) + (ORDER - 1) * len(counts), _START, np.int64)
        ends = np.cumsum(counts)
        self.at = np.arange(len(ids)) + np.repeat(np.arange(1, len(counts) + 1), counts) * (ORDER - 1)
        padded[self.at] = ids
        key = np.zeros(len(ids), np.int64)
        for back in range(ORDER - 1, -1, -1):
            key = key << 16 | padded[self.at - back]
        self.counts, self.ends = counts, ends
        keys, self.position, n = np.unique(key, return_inverse=True, return_counts=True)
        self.keys, self.events, self.histories = [keys], [n.astype(np.int64)], [np.zeros(len(keys), np.int64)]
        self.lower, self.context = [], []
        for order in range(ORDER - 1, -1, -1):
            mask = (1 << 16 * order) - 1
            above, n, m = self.keys[-1], self.events[-1], len(self.keys[-1])
            keys, at = np.unique(np.concatenate([above & mask, above >> 16]), return_inverse=True)
            self.lower.append(at[:m])
            self.context.append(at[m:])
            self.keys.append(keys)
            self.events.append(np.bincount(at[:m], n, len(keys)).astype(np.int64))
            self.histories.append(np.bincount(at[m:], n, len(keys)).astype(np.int64))

    def sent(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All keys tagged with their order, their order by bucket, and the bounds of buckets."""
        keys = np.concatenate([k | np.int64(ORDER - i) << 48 for i, k in enumerate(self.keys)])
        with np.errstate(over="ignore"):
            mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return keys, order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def token_losses(self, events: np.ndarray, histories: np.ndarray, vocabulary: int, without_own: bool = False, weight: float = 1.0) -> np.ndarray:
        """Loss in nats of every token by corpus counts of all keys (as ``sent`` lists them);
        ``without_own``: each text's own counts are taken off first."""
        bounds = np.cumsum([0, *(len(k) for k in self.keys)])
        of = np.repeat(np.arange(len(self.counts)), self.counts)
        at = [self.position]  # place of every token's n-gram in the keys of each order
        for lower in self.lower[:-1]:
            at.append(lower[at[-1]])
        p = np.full(len(of), 1 / vocabulary)
        for i in range(ORDER - 1, -1, -1):
            prior = vocabulary if i == ORDER - 1 else PRIOR
            context = self.context[i][at[i]]
            event, history = events[bounds[i] : bounds[i + 1]][at[i]], histories[bounds[i + 1] : bounds[i + 2]][context]
            if without_own:
                event, history = event - _same(of, at[i], len(self.keys[i])), history - _same(of, context, len(self.keys[i + 1]))
            p = (weight * event + prior * p) / (weight * history + prior)
        return -np.log(p)


def _same(owner: np.ndarray, key: np.ndarray, keys: int) -> np.ndarray:
    """How many entries share each entry's owner and key."""
    _, at, n = np.unique(owner * keys + key, return_inverse=True, return_counts=True)
    return n[at]


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of counts, each in its narrowest type, byte by byte in planes, compressed."""
    out = []
    for a in columns:
        kind = next(k for k in "BHIQ" if not len(a) or int(a.max()) <= np.iinfo(k).max)
        data = pa.compress(a.astype(kind).view(np.uint8).reshape(len(a), -1).T.tobytes(), "zstd", asbytes=True) if len(a) else b""
        out.append(struct.pack("<cII", kind.encode(), len(a), len(data)) + data)
    return b"".join(out)


def _unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<cII", data, at)
        at += 9
        width = np.dtype(kind.decode()).itemsize
        planes = pa.decompress(data[at : at + size], n * width, "zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind.decode()).ravel().astype(np.int64))
        at += size
    return out


def _split_keys(keys: np.ndarray) -> list[np.ndarray]:
    """Columns of keys that compress: steps of the order and first token, then the other two tokens."""
    return [np.diff(keys >> 32, prepend=0) & 0xFFFFFFFF, keys >> 16 & 0xFFFF, keys & 0xFFFF]


def _joined_keys(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    return (np.cumsum(first) & 0xFFFFFFFF) << 32 | second << 16 | third


def score_corpus(docs: DataFrame, target: DataFrame, background: DataFrame, ranks_path: str, slice_chars: int = SLICE, background_weight: float = 1.0) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row of ``docs``, by models of all n-grams."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    same = background is docs
    text = lambda df: df["text"].cast("string").alias("text")
    sizes = [df.select(F.sum(F.octet_length(text(df))).alias("n")).first()["n"] or 0 for df in ((docs, target) if same else (docs, target, background))]
    buckets = max(1, -(-sum(sizes) // slice_chars))

    def reader(asks: bool, model: int | None):
        """Rows of slices; those of documents carry the tokens too and ask for counts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = encoder(ranks_path)
            context = TaskContext.get()
            number = (context.partitionId() if context else 0) << 32
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for a, b in slices(texts, slice_chars):
                    parts = [enc.encode_batch(texts[a + x : a + y]) for x, y in slices(texts[a:b])]
                    ids, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    found = NgramSlice(ids, counts)
                    keys, order, bounds = found.sent(buckets)
                    keys, events, histories = keys[order], np.concatenate(found.events)[order], np.concatenate(found.histories)[order]
                    used = np.flatnonzero(np.diff(bounds))
                    spans = [(int(bounds[k]), int(bounds[k + 1])) for k in used]
                    rows = [
                        [number] * len(used),
                        used.tolist(),
                        [_packed(*_split_keys(keys[x:y]), *((events[x:y], histories[x:y]) if model is not None else ())) for x, y in spans],
                    ]
                    docs_ids = [None] * len(used)
                    tokens = [None] * len(used)
                    lengths = [None] * len(used)
                    if asks:
                        for column, value in zip(rows, (number, number % buckets, None), strict=True):
                            column.append(value)
                        docs_ids.append(batch.column(0).slice(a, b - a).to_pylist())
                        tokens.append(_packed(ids))
                        lengths.append(_packed(counts))
                    binary = [pa.array(c, pa.binary()) for c in (*rows[2:], tokens, lengths)]
                    n = len(rows[0])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(rows[0], pa.int64()),
                            pa.array(rows[1], pa.int32()),
                            pa.array([-1 if model is None else model] * n, pa.int32()),
                            pa.array([asks] * n, pa.bool_()),
                            *binary,
                            pa.array(docs_ids, pa.list_(batch.column(0).type)),
                        ],
                        names=["slice", "bucket", "model", "asks", "grams", "tokens", "lengths", "ids"],
                    )
                    number += 1

        return run

    schema = f"slice long, bucket int, model int, asks boolean, grams binary, tokens binary, lengths binary, ids array<{kind}>"
    nobody = F.lit(None).cast(kind).alias("doc_id")
    sent = docs.select("doc_id", text(docs)).mapInArrow(reader(True, 1 if same else None), schema)
    sent = sent.unionByName(target.select(nobody, text(target)).mapInArrow(reader(False, 0), schema))
    if not same:
        sent = sent.unionByName(background.select(nobody, text(background)).mapInArrow(reader(False, 1), schema))

    def add_up(group: pa.Table) -> pa.Table:
        lists = group.filter(pa.compute.is_valid(group["grams"]))
        grams = [_unpacked(g) for g in lists["grams"].to_pylist()]
        keys = [_joined_keys(*g[:3]) for g in grams]
        distinct, at = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
        total = np.zeros((4, len(distinct)), np.int64)  # target events, histories; background events, histories
        asked, end = [], 0
        for g, slice_, bucket, model, asks in zip(grams, *(lists[c].to_pylist() for c in ("slice", "bucket", "model", "asks")), strict=True):
            own = at[end : end + len(g[0])]  # distinct within a slice
            end += len(g[0])
            for row, counts in zip(total[2 * model : 2 * model + 2], g[3:], strict=False):  # none for rows that only ask
                row[own] += counts
            if asks:
                asked.append((slice_, bucket, own))
        answers = [_packed(*total[:, own]) for _, _, own in asked]
        texts = group.filter(pa.compute.is_valid(group["tokens"]))
        n, m = len(asked), texts.num_rows
        return pa.table(
            {
                "slice": pa.array([a[0] for a in asked] + texts["slice"].to_pylist(), pa.int64()),
                "bucket": pa.array([a[1] for a in asked] + [-1] * m, pa.int32()),
                "answer": pa.array(answers + [None] * m, pa.binary()),
                **{c: pa.array([None] * n + texts[c].to_pylist(), texts[c].type) for c in ("tokens", "lengths", "ids")},
            }
        )

    def finish(group: pa.Table) -> pa.Table:
        rows = group.filter(pa.compute.is_valid(group["tokens"])).slice(0, 1)
        (counts,) = _unpacked(rows["lengths"][0].as_py())
        (ids,) = _unpacked(rows["tokens"][0].as_py())
        found = NgramSlice(ids, counts)
        keys, order, bounds = found.sent(buckets)
        answers = group.filter(pa.compute.greater_equal(group["bucket"], 0))
        value = np.zeros((4, len(keys)), np.int64)
        for bucket, answer in zip(answers["bucket"].to_pylist(), answers["answer"].to_pylist(), strict=True):
            value[:, order[bounds[bucket] : bounds[bucket + 1]]] = _unpacked(answer)
        vocabulary = len(encoder(ranks_path).ranks)
        full = np.flatnonzero(counts)
        first = (found.ends - counts)[full]
        columns = []
        for model in (0, 2):
            mean = np.full(len(counts), np.nan)
            if len(full):
                weight = background_weight if model else 1.0
                losses_ = found.token_losses(value[model], value[model + 1], vocabulary, same and model == 2, weight)
                mean[full] = np.add.reduceat(losses_, first) / counts[full]
            columns.append(mean)
        columns.append(columns[0] - columns[1])
        out = [rows["ids"].combine_chunks().flatten(), pa.array(counts), *(pa.array(c, mask=counts == 0) for c in columns)]
        return pa.table(out, names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    answered = sent.groupBy("bucket").applyInArrow(
        add_up, f"slice long, bucket int, answer binary, tokens binary, lengths binary, ids array<{kind}>"
    )
    return answered.groupBy("slice").applyInArrow(finish, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, score double")
