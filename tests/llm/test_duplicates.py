"""Near-duplicates and repeated passages against brute force."""

import hashlib
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import near_dedup as N
from docloom.llm import queries as Q
from docloom.llm import substring_dedup as S
from docloom.llm.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, lower=True):
    if lower:
        text = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    w = WORDS.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("percent", "matches"), [(85, 36), (80, 30)])
def test_groups_equal_brute_force(docs, corpus, percent, matches):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicate_groups(docs, percent, matches).collect()}
    assert got == brute_groups(corpus, percent)


def test_many_variants_of_one_text(spark):
    """A group whose members are linked to its centre only in part; no link may be lost."""
    import random

    rng = random.Random(3)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for d in range(90):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
        rows.append((d, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicate_groups(frame).collect()}
    assert got == brute_groups(rows, 85)


def variants(n, edits, length=110, seed=7):
    """Texts of one base whose pairs all stay below the threshold."""
    import random

    rng = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    rows = []
    for d in range(n):
        words = list(base)
        for k in range(edits):
            words[(d * 13 + k * (length // edits) + rng.randrange(8)) % length] = f"e{d}x{k}"
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize("n", [150, 300, 600])
def test_variants_below_the_threshold_name_no_pairs(n):
    """What a block names is bounded by its members, however many of its pairs pass the bounds."""
    import numpy as np
    import pyarrow as pa

    rows = variants(n, 1)
    for percent in (85, 99):  # all linked; none linked
        h, off, _ = N.shingle_sets(*N.utf8_buffers(pa.array([t for _, t in rows])))
        sizes = np.diff(off)
        sig = N.signatures(h, off)
        table = pa.table({
            "cls": np.arange(n), "comp": np.arange(n), "mine": np.zeros(n, np.int32), "n": sizes, "shared": sizes, "prefix": np.full(n, -1), "coord": np.zeros(n, np.int32), "p": np.zeros(n, np.int32), "q": np.zeros(n, np.int32),
            "sig": pa.array(list(sig.view(np.int32))), "items": pa.array([h[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary()),
        })
        u, v = N.links_of_block(table, 36, percent)
        assert len(u) == len(v) and len(u) <= (n - 1 if percent == 85 else 0)
        if percent == 85:
            sets = [set(h[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]
            assert all(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a, b in zip(u, v, strict=True))
            assert len(u) > n // 2


def thue_morse(n, flip=False):
    """A word and its complement, equal under every polynomial hash modulo a power of two."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096, 8192])
def test_regular_words_are_told_apart(spark, n):
    import numpy as np

    from docloom.llm.common import span_hashes

    a, b = thue_morse(n), thue_morse(n, True)
    raw = np.frombuffer((a + b).encode(), np.uint8)
    for lane in (0, 1):
        h = span_hashes(raw, np.array([0, n]), np.array([n, 2 * n]), lane)
        assert h[0] != h[1]
    common = [f"w{i}" for i in range(35)]
    text = lambda w: " ".join([*common[:17], w, *common[18:]])
    rows = [(1, text(a)), (2, text(b)), (3, a), (4, b), (5, f"{a} {b} x y z"), (6, f"{b} {a} x y z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in N.near_duplicate_groups(frame).collect()} == {d: d for d, _ in rows}
    assert all(r["n_removed"] == 0 for r in S.dedup_substrings(frame).collect())
    twice = spark.createDataFrame([*rows, (7, "before " + text(a))], "doc_id long, text string").repartition(2)
    assert {r["doc_id"]: r["n_removed"] for r in S.dedup_substrings(twice).collect()} == {1: 35, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 35}


def test_span_hashes_depend_on_the_span_alone():
    import numpy as np

    from docloom.llm.common import span_hashes

    rng = np.random.default_rng(2)
    spans = [bytes(rng.integers(0, 4, n, dtype=np.uint8)) for n in [*range(1, 70), 7, 8, 9, 15, 16, 17, 200]]
    once, seen = [], {}
    for lane in (0, 1):
        alone = [int(span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]), lane)[0]) for x in spans]
        ends = np.cumsum([len(x) for x in spans])
        together = span_hashes(np.frombuffer(b"".join(spans), np.uint8), ends - [len(x) for x in spans], ends, lane)
        assert together.tolist() == alone
        for x, h in zip(spans, alone, strict=True):
            assert seen.setdefault((lane, h), x) == x
        once.append(alone)
    assert not set(once[0]) & set(once[1])


def test_ids_that_repeat_with_other_texts_lose_no_link(spark):
    a, b = variants(2, 1, seed=1), [(0, " ".join(f"c{i}" for i in range(100))), (1, " ".join(f"c{i}" for i in range(1, 101)))]
    rows = [(1, a[0][1]), (1, b[0][1]), (2, b[1][1]), (3, a[1][1]), (9, "alone in here with five words"), (None, b[0][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in N.near_duplicate_groups(frame).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (9, 9), (None, 1)], key=str)
    kept = [(r["doc_id"], r["text"]) for r in N.drop_copies(frame).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[1], rows[4], rows[5]], key=str)


def test_passages_of_rows_after_a_shuffle(docs, corpus):
    got = {r["doc_id"]: r["n_removed"] for r in S.dedup_substrings(docs.repartition(5, "doc_id")).collect()}
    assert got == {d: v[1] for d, v in brute_passages(corpus).items()}


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_groups_of_an_empty_table(empty):
    assert N.near_duplicate_groups(empty).collect() == []


def brute_passages(rows, k=35):
    words = {d: WORDS.findall(t or "") for d, t in rows}
    seen = Counter(tuple(w[i : i + k]) for w in words.values() for i in range(len(w) - k + 1))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_passages_equal_brute_force(spark, docs, corpus, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in Q.op10_repeated_passages(spark, str(tmp_path)).collect()}
    assert got == brute_passages(corpus)


@pytest.mark.parametrize("window", [8, 12, 35])
def test_windows_of_other_lengths(docs, corpus, window):
    got = {r["doc_id"]: r["n_removed"] for r in S.dedup_substrings(docs, window).collect()}
    assert got == {d: v[1] for d, v in brute_passages(corpus, window).items()}


def test_strip_repeats_keeps_columns(docs, corpus):
    out = S.strip_repeats(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r["text"].encode().split() for r in out.select("doc_id", "text").collect()}
    assert {d: len((t or "").encode().split()) - len(kept[d]) for d, t in corpus} == {d: v[1] for d, v in brute_passages(corpus).items()}
    assert out.select("tok", "n", "row_id").distinct().count() == 1


def test_passages_of_an_empty_table(empty):
    assert S.dedup_substrings(empty).collect() == []


def test_repeated_rows_count_as_repeats(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r["n_removed"] for r in S.dedup_substrings(rows).collect()] == [50, 50]
    assert [r["component_id"] for r in N.near_duplicate_groups(rows).collect()] == [1, 1]


def test_plans_have_no_cross_join(docs):
    plan = S.dedup_substrings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan
    assert F is not None
