"""Merkle manifest, nearest vectors and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import merkle, nearest, resampling


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ manifest
def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) of each row (doc_id, source, ...)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = [sha("".join(map(field, r))) for r in rows]

    def tree(nodes):
        paths, own = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for x, place in enumerate(own):
                run, p = runs[place // 16], place % 16
                paths[x].append(("".join(run[:p]), "".join(run[p + 1 :])))
                own[x] //= 16
            nodes = [sha("".join(r)) for r in runs]
        return nodes[0], paths

    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[1], []).append(k)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sub, paths = {}, {}
    for g in names:
        ks = sorted(groups[g], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf[k]))
        sub[g], ways = tree([leaf[k] for k in ks])
        paths |= dict(zip(ks, ways, strict=True))
    root, tops = tree([sub[g] for g in names]) if rows else ("", [])
    return [(r[0], leaf[k], sub[r[1]], root, paths[k] + tops[names.index(r[1])]) for k, r in enumerate(rows)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, row long, part int"


def manifest_of(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(5)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return merkle.manifest(frame, merkle.digest(columns), F.col("source"), [F.col("doc_id")], {"doc_id": F.col("doc_id")})


@pytest.mark.parametrize("n", [0, 1, 17, 9000])
def test_manifest_equals_brute_force(spark, monkeypatch, n):
    """Hot group, groups of one row, null, empty and repeated sources, ids and rows; many partitions, so that most runs of siblings cross no border and some do."""
    monkeypatch.setattr(merkle, "ROWS", 700)
    rng = random.Random(n)
    rows = [(i if i % 97 else None, rng.choice([None, "a", "", "é", *["hot"] * 4]) if i % 10 else f"s{i % 2000}", "x", i, None if i % 7 == 0 else f"T{i % 50}ü") for i in range(n)]
    rows += rows[: n // 3]
    rng.shuffle(rows)
    out = manifest_of(spark, rows).withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn("all", F.sha2(merkle.siblings(F.col("proof")), 256)).collect()
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in out), key=str)
    assert got == sorted(brute_manifest(rows), key=str)
    assert all(r["folded"] == r["root"] and r["all"] == sha("".join(a + b for a, b in r["proof"])) for r in out)


def test_a_changed_row_is_found(spark):
    rows = [(i, "ab"[i % 2], "x", i, f"text {i}") for i in range(100)]
    out = manifest_of(spark, rows).withColumn("folded", merkle.fold(F.when(F.col("doc_id") == 40, F.sha2(F.lit("other"), 256)).otherwise(F.col("leaf")), F.col("proof"))).collect()
    assert [r["doc_id"] for r in out if r["folded"] != r["root"]] == [40]


@pytest.mark.parametrize(("start", "length", "total"), [(0, 1, 1), (0, 16, 16), (0, 17, 17), (5, 300, 1000), (16, 256, 4096), (990, 10, 1000), (7, 3, 5000), (0, 4096, 4097), (4096, 1, 4097)])
def test_spans_build_what_lies_inside(start, length, total):
    nodes = [sha(str(i)) for i in range(total)]
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    span = merkle.Span(nodes[start : start + length], start, total)
    ragged = list(span.ragged())
    covered = sorted(i for level, place, _ in ragged for i in range(place * 16**level, min((place + 1) * 16**level, total)))
    assert covered == list(range(start, start + length))
    assert all(levels[level][place] == node for level, place, node in ragged)
    assert len(ragged) <= 30 * len(levels)


# ------------------------------------------------------------------ nearest
def brute_nearest(rows, k=10, every=100):
    known = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    vectors, ids = np.array([v for _, v in known]), np.array([i for i, _ in known])
    out = []
    for j, (i, v) in enumerate(known):
        if i % every == 0:
            d, others = np.sqrt(np.cumsum((vectors - v) ** 2, axis=1)[:, -1]), np.arange(len(ids)) != j
            order = np.lexsort((ids[others], d[others]))[:k]
            out += [(i, n + 1, int(ids[others][x]), float(d[others][x])) for n, x in enumerate(order)]
    return sorted(out)


def found_nearest(frame, **kw):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest(frame, F.col("id") % 100 == 0, **kw).collect())


def test_nearest_with_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 8)).round(1).astype(np.float32).astype(float)
    rows = [(i, base[rng.integers(200)].tolist()) for i in range(700)] + [(i, [1.0] * 8) for i in range(1000, 1400)]
    odd = [(100, [1.0] * 8), (None, [1.0] * 8), (2000, None), (2100, []), (2200, [0.0] * 8), (2300, [math.nan] * 8), (2400, [None] + [1.0] * 7), (2500, [-0.0] + [1.0] * 7), (2600, [0.0] + [1.0] * 7), (2800, [math.inf] * 8)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in [*rows, *odd, (2700, [1.0] * 3)]], "vec_id long, embedding array<float>, cls int, blob string").repartition(5)
    assert found_nearest(frame) == brute_nearest(rows + odd)


def test_few_candidates_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (100, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert found_nearest(frame, curves=4) == [(0, 1, 100, 0.0), (0, 2, 1, 0.5), (100, 1, 0, 0.0), (100, 2, 1, 0.5)]
    assert found_nearest(frame.limit(0), curves=4) == [] and found_nearest(frame.where("vec_id = 0"), curves=4) == []


def test_recall_over_many_windows(spark):
    """Gaussian clusters over 30 windows a curve: nine tenths of the neighbours are found, with their exact distances, nearest first."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 24))[rng.integers(40, size=7800)] + 0.7 * rng.normal(size=(7800, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = found_nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=256)
    want = brute_nearest(rows)
    assert len(got) == len(want) == 780
    assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    for q, n, v, score in got:
        assert score == np.sqrt(np.cumsum((vectors[q] - vectors[v]) ** 2)[-1])
    assert all(a[0] != b[0] or (a[3], a[2]) <= (b[3], b[2]) for a, b in zip(got, got[1:], strict=False))


def test_hilbert_steps_are_neighbours():
    for dims, bits in ((2, 4), (3, 3), (6, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = nearest.hilbert(grid, bits)
        assert sorted(place.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# ------------------------------------------------------------------ resampling
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features_of(text, n):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, n=1, buckets=10_000, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in features_of(x, n)[1]), Counter(bucket(f) for x in target for f in features_of(x, n)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for d, text in rows:
        words, found = features_of(text, n)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(sha(f"2024:{'' if d is None else d}")[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[1]))
    for i, o in enumerate(able[: len(able) * percent // 100]):
        o[4] = i + 1
    return sorted((o[:5] for o in out), key=str)


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (2, 300, 37), (3, 1, 100)])
def test_resampling_equals_brute_force(spark, n, buckets, percent):
    """Null, empty and repeated rows and ids, a word that most documents have, words of any bytes; few buckets collide."""
    rng = random.Random(n)
    word = lambda: rng.choice(["The", "hot", "hot", "x" * 100, "ÄÖ-b", "9a", "日本", f"w{rng.randrange(50)}"])
    rows = [(i if i % 9 else None, None if i % 11 == 0 else rng.choice([" ", "\n", "--"]).join(word() for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [*rows[:40], (1000, ""), (1001, "hot " * 30_000)]
    target = ["hot w1 w2 w3", None, "Unseen words HERE", "x" * 100]
    frame = spark.createDataFrame([(d, t, 1, 2.0) for d, t in rows], "doc_id long, text string, block int, total double").repartition(6)
    got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, max_run=n, buckets=buckets)
    assert sorted(([*r] for r in got.collect()), key=str) == brute_resample(rows, target, n, buckets, percent)


def test_resampling_without_target_or_documents(spark, docs, corpus, empty):
    none = spark.createDataFrame([], "text string")
    assert sorted(([*r] for r in resampling.resample(docs, none).collect()), key=str) == brute_resample(corpus, [])
    assert resampling.resample(empty, none).collect() == []


def test_large_buckets_are_split_and_small_ones_put_together():
    size = np.array([1, 1, 100, 1, 1, 0, 3, 60, 2])
    deal = resampling.deal_buckets(size, 10)
    held = Counter()
    for b, n in enumerate(size.tolist()):
        for j in range(int(deal.parts[b])):
            held[int(deal.first[b]) + j] += n / deal.parts[b]
    assert deal.parts.tolist() == [1, 1, 6, 1, 1, 1, 1, 4, 1] and max(held.values()) <= 17 and max(held) < deal.slices
    alone = [set(range(int(deal.first[b]), int(deal.first[b] + deal.parts[b]))) for b in (2, 7)]
    assert not alone[0] & alone[1]
