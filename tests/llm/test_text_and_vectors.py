"""Spelling variants, substring dedup and centroid clustering against brute-force versions, with nulls,
empty and long texts, repeats, ties, empty tables and extra columns whose names clash with inner ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import centroids, spelling, substring_dedup

CLASH = "word string, n long, run long, span string, start int, key string, cut boolean, windows string, maybe boolean, cluster int, v string, ids string"


def frame(spark, rows, kind="long"):
    extra = ("x", 1, 2, "y", 3, "k", True, "w", False, 4, "v", "i")
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], f"doc_id {kind}, text string, {CLASH}").repartition(3)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# -- spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def spelled(rows):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    others = {w: sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x)) for w in words}
    form = {w: o[0] if o and words[o[0]] >= 10 * words[w] else None for w, o in others.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(others[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=str)


def spelled_rows():
    rng = random.Random(5)
    base = ["ÉLÉPHANTS", "bananas", "abababab", "aaaaaaa", "aaaaaaaa", "running", "runnings", "mississippi", "naïveté", "x×÷yzabc"]
    rows = []
    for doc in range(240):
        words = [rng.choice(base[: 1 + doc % len(base)]) for _ in range(12)]
        for _ in range(3):
            w = list(rng.choice(base))
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "q", "é"])
            words.append("".join(w))
        rows.append((doc, rng.choice([" ", "-", "9", ". "]).join(words)))
    return [*rows, *[(500, "chained " * 2000), (500, "chainedd " * 30), (501, "chaineddd " * 2)], rows[0], rows[0], (None, "bananas bananas"), (None, None), (7, ""), (8, "a" * 5000 + " " + "a" * 5000), (9, "tïetïes tïetïes tietïes tietïes tïeties tïeties tieties tieties")]


def test_spelling_variants(spark):
    rows = spelled_rows()
    out = rows_of(spelling.variants(frame(spark, rows)), "word", "form", "root", "n", "n_near", "form_n")
    assert out == spelled(rows)
    assert any(r[1] and r[2] != r[1] for r in out), "no chain of forms"
    assert rows_of(spelling.variants(frame(spark, [])), "word") == []


def test_rare_prefixes_find_all_near_pairs(spark):
    rng = random.Random(9)
    for letters, lengths in (("ab", range(4, 10)), ("abcdé", range(4, 8))):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(220)})
        found = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"))
        assert rows_of(found, "word", "other") == sorted((a, b) for a in words for b in words if near(a, b))
        kept = spelling.rarest(spark.createDataFrame([(w,) for w in words], "word string"))
        assert {len(r["at"]) for r in kept.collect()} == {3}


# -- substring dedup


def removed(rows, window=13):
    split = [re.findall("[^ \t-\r]+", t or "") for _, t in rows]
    holders = defaultdict(list)
    for (doc_id, _), words in zip(rows, split, strict=True):
        for i in range(len(words) - window + 1):
            if doc_id is not None:
                holders[tuple(words[i : i + window])].append(doc_id)
    out = []
    for (doc_id, _), words in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if doc_id is not None and min(holders[tuple(words[i : i + window])]) < doc_id:
                gone |= set(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)] + ["the", "the", "of", "é", "東京"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [text(n) for n in (13, 14, 30, 60)]
    rows = []
    for doc in range(150):
        parts = [w for k in range(rng.randrange(4)) for w in [*text(rng.randrange(20)), *rng.choice(shared)[rng.randrange(3) :]]] + text(5)
        rows.append((doc * 3, rng.choice([" ", "\n", "\t ", "  "]).join(parts)))
    line = text(9)  # shorter than a window, in ever new company
    rows += [(1000 + k, " ".join([*text(8), *line, *text(8)])) for k in range(60)] + [(2000, " ".join([*text(3), *rows[-1][1].split(), "end"]))]
    rows += [(3000 + k, "same " * n) for k, n in enumerate((12, 13, 40, 3000))] + [(3100, "a b " * 40), (3101, "b a " * 30)]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1]), (None, rows[0][1]), (None, None), (5, None), (6, ""), (7, " \t\n ")]
    return rows


@pytest.mark.parametrize("common", [512, 3])  # with 3, most runs are cut into windows
def test_substring_dedup(spark, monkeypatch, common):
    monkeypatch.setattr(substring_dedup, "COMMON", common)
    rows = passages()
    assert rows_of(substring_dedup.digests(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == removed(rows)
    named = [(None if i is None else f"id{i:05}", t) for i, t in rows]
    assert rows_of(substring_dedup.digests(frame(spark, named, "string")), "doc_id", "n_words", "n_removed", "kept_sha256") == removed(named)


def test_substring_dedup_returns_spans_and_text(spark):
    line = " ".join(f"p{k}" for k in range(20))
    out = {r["doc_id"]: r for r in substring_dedup.dedup(frame(spark, [(1, line), (2, f"before  {line}\nafter"), (3, "short")])).collect()}
    assert out[1]["removed"] == [] and out[1]["kept"] == line
    assert [tuple(s) for s in out[2]["removed"]] == [(1, 21)] and out[2]["kept"] == "before after"
    assert rows_of(substring_dedup.digests(frame(spark, [])), "doc_id") == []


def test_words_of_bytes():
    texts = ["", "one", "two three", " four", "", "é\u00a0\u2003x\x0by\x1cz", "w" * 63, "w" * 64, "w" * 65, "w" * 200 + " " + "w" * 201, "tail "]
    column = pa.array(["cut off", *texts]).slice(1)
    for size in (1, 40, 1 << 19):
        seen, hashes = [], {}
        for a, b, words in substring_dedup.word_slices(column, size):
            ends = np.cumsum(words.counts)
            for k, end in enumerate(ends.tolist()):
                own = [words.piece(i, i + 1).decode() for i in range(end - int(words.counts[k]), end)]
                seen.append(own)
                for i, w in zip(range(end - len(own), end), own, strict=True):
                    assert hashes.setdefault(w, int(words.hashes[i])) == int(words.hashes[i])
            assert b - a == len(words.counts)
        assert seen == [re.findall("[^ \t-\r]+", t) for t in texts] and len(set(hashes.values())) == len(hashes)


def test_automaton_gives_least_owners():
    rng = random.Random(2)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(5, 40))] for _ in range(12)]
    owners = [rng.randrange(100) for _ in texts]
    held = substring_dedup.Automaton()
    for text, owner in zip(texts, owners, strict=True):
        held.add(text, owner)
    held.settle()
    inside = lambda part, text: any(text[i : i + len(part)] == part for i in range(len(text)))
    for text in [*texts, [rng.randrange(4) for _ in range(60)]]:
        for end, (matched, owner) in enumerate(zip(*held.statistics(text, 6), strict=True), 1):
            longest = max(n for n in range(7) if n <= end and (n == 0 or any(inside(text[end - n : end], t) for t in texts)))
            assert matched == longest
            if matched:
                assert owner == min(o for t, o in zip(texts, owners, strict=True) if inside(text[end - matched : end], t))


# -- centroids


def lloyd(rows, clusters, rounds, dims, scale=256):
    kept = [(i, np.array([int(np.floor(float(x) * scale)) for x in e])) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    start = sorted((k for k in kept), key=lambda k: (k[0] is None, hashlib.sha256(f"2:{k[0]}".encode()).hexdigest(), k[1].tolist()))
    means = [v.copy() for _, v in start[:clusters]]

    def nearest(v):
        return min((int(((v - m) ** 2).sum()), c) for c, m in enumerate(means))

    for _ in range(rounds):
        owner = [nearest(v)[1] for _, v in kept]
        for c in range(len(means)):
            own = [v for o, (_, v) in zip(owner, kept, strict=True) if o == c]
            if own:
                means[c] = np.array([int(x) // len(own) for x in np.sum(own, axis=0)])
    last = [nearest(v) for _, v in kept]
    within = Counter()
    for d, c in last:
        within[c] += d
    name = [hashlib.sha256(",".join(map(str, m.tolist())).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, within[c], sum(within.values()), name[c]) for (i, _), (d, c) in zip(kept, last, strict=True)), key=str)


def vectors(dims):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=dims) * 0.2 + rng.integers(0, 3)).astype(np.float32).tolist()) for k in range(180)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (None, [0.5] * dims)] + [(300 + k, rows[7][1]) for k in range(90)]
    rows += [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [None] + [1.0] * (dims - 1)), (904, [float("nan")] * dims), (905, [float("inf")] * dims), (906, [-0.0] * dims), (907, [1e-9, -1e-9] * (dims // 2))]
    return rows


@pytest.mark.parametrize("clusters,rounds", [(12, 5), (1, 2), (500, 3), (7, 40)])
def test_delta_rounds_equal_full_rounds(spark, clusters, rounds):
    rows = vectors(6)
    table = spark.createDataFrame([(i, e, "c", 1) for i, e in rows], "vec_id long, embedding array<float>, cluster string, n int").repartition(4)
    out = centroids.cluster(table, clusters, rounds, 6)
    assert rows_of(out, "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == lloyd(rows, clusters, rounds, 6)


def test_centroids_of_odd_tables(spark):
    kind = "vec_id string, embedding array<double>"
    assert centroids.cluster(spark.createDataFrame([], kind), 3, 2, 4).collect() == []
    assert centroids.cluster(spark.createDataFrame([("a", [1.0])], kind), 3, 2, 4).collect() == []
    large = [("a", [9000.5] * 4), ("b", [-12000.25] * 4), ("c", [100000.0] * 4), ("d", [9000.0] * 4)]
    assert rows_of(centroids.cluster(spark.createDataFrame(large, kind), 2, 3, 4), "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == lloyd(large, 2, 3, 4)
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster(spark.createDataFrame([("a", [1e6] * 4)], kind), 1, 1, 4).collect()


def test_only_changed_centroids_and_moved_vectors_are_compared(monkeypatch):
    compared = []
    real = centroids.squares
    monkeypatch.setattr(centroids, "squares", lambda v, c: compared.append((len(v), len(c))) or real(v, c))
    v = np.array([[0], [1], [10], [11], [20]], np.int64)
    means = np.array([[0], [10], [20]], np.int64)
    owners, distances = centroids.assign(v, np.full(5, -1, np.int16), np.zeros(5, np.int64), means, np.ones(3, bool))
    assert owners.tolist() == [0, 0, 1, 1, 2] and compared == [(5, 3)]
    compared.clear()
    again = centroids.assign(v, owners, distances, np.array([[0], [11], [20]]), np.array([False, True, False]))
    assert again[0].tolist() == [0, 0, 1, 1, 2] and again[1].tolist() == [0, 1, 1, 0, 0] and compared == [(2, 3), (3, 1)]
    assert centroids.transfers(v, np.array([0, 0, 1, -1, 2]), np.array([0, 1, 1, 2, 2])) == [{"cluster": 0, "n": -1, "sums": [-1]}, {"cluster": 1, "n": 1, "sums": [1]}, {"cluster": 2, "n": 1, "sums": [11]}]
