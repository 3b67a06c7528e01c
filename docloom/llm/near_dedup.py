"""Near-duplicate groups by a signature-coordinate inverted join.

A document's set holds its distinct five-word shingles (fewer words: the whole sequence). Documents with equal sets form a class, of
which one representative goes on, so copies cost nothing further. A class has a MinHash signature of ``COORDINATES`` values and is posted under each
(coordinate, value) pair. Sets with Jaccard at or above the threshold agree in ``MATCHES`` or more coordinates (odds against:
under 10**-7 for 0.85), which prunes twice:

* skip: postings that nobody shares are dropped by a count over all postings, and with them every class with fewer than ``MATCHES`` left;
* prefix: of a class's s shared postings, ordered by how common they are, only the s - MATCHES + 1 rarest are merged, since two classes that
  agree in MATCHES coordinates meet in one of those.

The classes left are then bounded exactly: with c of a class's n shingles shared by any other, two classes have at most
min(c) in common, so a class with c below the threshold's share of n can have no link, nor can a pair whose bound is below it.

Within a posting, pairs are not written out: its members are held against its most central member (the one whose postings are the most
common), pairs with enough equal coordinates are confirmed on full sets, and confirmed links join components. Where a posting still spans
several components, its members meet block by block inside tasks, each block with its members' sets: collisions are counted, bounds and full
sets decide at once, and a union-find in the task names a link only where it joins two components. What a task writes is thus
bounded by its members, however many pairs there are, and no component is lost.

Classes are numbered apart from documents, so an id that repeats with other texts is in several classes.

Defined results: null or empty texts, and texts without words, have an empty set and are linked with nothing; equal texts
share a component; each row gives a row and is judged by its own text, rows that share an id are not linked by it; a row without an id
has the component of equal texts, if any; very long texts are whole sets like any other, handled one at a time where they exceed a slice;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SECOND_BASE, WindowHasher, discard, docs_text, lower_ascii, materialize, mix, narrow, partitions_for, ranges, slices, span_hashes, utf8_buffers, word_spans
from .components import connected_components
from .substring_dedup import BLOCK, BLOCKS, repeated, settle

SHINGLE = 5
COORDINATES = 64
MATCHES = 36
#: Ids up to which a list of active classes is broadcast; beyond, it is joined by shuffle.
BROADCAST_IDS = 250_000
#: Members of a posting, and shingles of their sets, in one block of the last step: some 10 MB.
BLOCK_MEMBERS, BLOCK_SHINGLES = 4_096, 1_000_000
#: Files a core writes of each intermediate table.
FILES = 2
_U64 = np.uint64
_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)) | _U64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' sorted distinct shingle hashes, one after another, their offsets, and each shingle's second hash (of the words' other lane)."""
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, off)
    n = np.diff(first)
    hasher, second = WindowHasher(span_hashes(data, starts, ends)), WindowHasher(span_hashes(data, starts, ends, 1), SECOND_BASE)
    counts = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    begin = ranges(first[:-1], counts)
    doc = np.repeat(np.arange(len(n)), counts)
    length = np.minimum(n, shingle)[doc]
    h = mix(hasher.runs(begin, length) + length.astype(_U64))
    order = np.lexsort((h, doc))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    kept = order[new]
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))]), mix(second.runs(begin[kept], length[kept]) + length[kept].astype(_U64))


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, COORDINATES) minima; zeros for empty sets."""
    sizes = np.diff(off)
    out = np.zeros((len(sizes), COORDINATES), np.uint32)
    full = np.flatnonzero(sizes > 0)
    if len(full):
        at = off[:-1][full]
        for c in range(COORDINATES):
            out[full, c] = np.minimum.reduceat(((h * _FACTORS[c]) >> _U64(32)).astype(np.uint32), at)
    return out


def set_keys(h: np.ndarray, off: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a set, as two longs, one from each hash of its shingles."""
    total = [np.concatenate([[_U64(0)], np.cumsum(mix(x + _U64(salt)), dtype=_U64)]) for x, salt in ((h, 0x1234567), (h2, 0x89ABCDEF))]
    a, b = (t[off[1:]] - t[off[:-1]] for t in total)
    return a.view(np.int64), b.view(np.int64)


def _binary_rows(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * flat.dtype.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def signed_docs(texts: DataFrame) -> DataFrame:
    """``doc_id, text_key, n, k1, k2, sig`` (array of COORDINATES ints) of ``doc_id, text``; ``text_key`` hashes the exact text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 19):
            h, off, h2 = shingle_sets(*utf8_buffers(batch.column(1)))
            k1, k2 = set_keys(h, off, h2)
            sig = signatures(h, off)
            column = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, COORDINATES, dtype=np.int32), pa.array(sig.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(off)), pa.array(k1), pa.array(k2), column], ["doc_id", "text_key", "n", "k1", "k2", "sig"])

    return texts.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, n long, k1 long, k2 long, sig array<int>")


def class_sets(docs: DataFrame, active: DataFrame) -> DataFrame:
    """``cls, items``: the full sets (blobs of sorted 64-bit hashes) of the classes listed in ``active`` (``cls, doc_id, k1, k2``).

    Only documents whose id stands for a listed class are read again; the keys tell which of them has its set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            h, off, h2 = shingle_sets(*utf8_buffers(batch.column(1)))
            k1, k2 = set_keys(h, off, h2)
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), _binary_rows(h, off)], ["k1", "k2", "items"])

    ids, keys = active.select("doc_id").distinct(), active.select("k1", "k2", "cls")
    if active.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids, keys = F.broadcast(ids), F.broadcast(keys)
    return docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "k1 long, k2 long, items binary").join(keys, ["k1", "k2"]).select("cls", "items").dropDuplicates(["cls"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``u, v``) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, _U64), np.frombuffer(y, _U64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    left = sets.select(F.col("cls").alias("u"), F.col("items").alias("x"))
    right = sets.select(F.col("cls").alias("v"), F.col("items").alias("y"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _equal_coordinates(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def shared_postings(classes: DataFrame, matches: int) -> DataFrame:
    """``tok, coord, cls, central``: prefix postings of the classes that can have a partner."""
    posts = classes.select("cls", F.posexplode("sig").alias("coord", "value")).select("cls", "coord", (F.shiftleft(F.col("coord").cast("long"), 32) + F.col("value").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("tok"))
    common = posts.groupBy("tok").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    shared = posts.join(common, "tok")
    mine = Window.partitionBy("cls")
    ranked = shared.select("*", F.count(F.lit(1)).over(mine).alias("s"), F.sum("freq").over(mine).alias("central"), F.row_number().over(mine.orderBy("freq", "tok")).alias("rank"))
    return ranked.where((F.col("s") >= matches) & (F.col("rank") <= F.col("s") - (matches - 1))).select("tok", "coord", "cls", "central")


def bounded_classes(sets: DataFrame, percent: int) -> DataFrame:
    """``cls, n, shared``: set sizes and how many of the shingles some other class has, for classes that can have a link."""
    parts = partitions_for(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in slices(batches, 1):
            data, off = utf8_buffers(batch.column(1))
            counts = np.diff(off) // 8
            held.append((data.view(_U64).copy(), np.repeat(batch.column(0).to_numpy(), counts), ranges(np.zeros(len(counts), np.int64), counts).astype(np.uint32)))
            size += int(counts.sum())
            if size >= BLOCK:
                yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)
                held, size = [], 0
        if size:
            yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)

    found = repeated(sets.mapInArrow(run, BLOCKS), parts).select(F.col("row_id").alias("cls"), (F.length("positions") / 4).cast("long").alias("shared"))
    sized = sets.select("cls", (F.length("items") / 8).cast("long").alias("n"))
    return sized.join(found, "cls").where(100 * F.col("shared") >= percent * F.col("n"))


def star_pairs(postings: DataFrame) -> DataFrame:
    """``u`` (a member) and ``v`` (the most central member) of every posting."""
    lead = F.struct(F.col("central"), (-F.col("cls")).alias("minus"))
    heads = postings.groupBy("tok").agg(F.max(lead).alias("head"))
    return postings.join(heads, "tok").select(F.col("cls").alias("u"), (-F.col("head.minus")).alias("v")).where("u != v").distinct()


def similar_pairs(pairs: DataFrame, classes: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs with enough equal coordinates whose bound reaches the threshold."""
    left = classes.select(F.col("cls").alias("u"), F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("c_a"))
    right = classes.select(F.col("cls").alias("v"), F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("c_b"))
    most = F.least("c_a", "c_b")
    may = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    return pairs.join(left, "u").join(right, "v").where(may & (_equal_coordinates("a", "b") >= matches)).select("u", "v")


def remaining_links(postings: DataFrame, comp: DataFrame, classes: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links (``u, v``) that join components which share a posting: the exact rest after the stars.

    Postings that still span components are cut into blocks of members; two blocks meet in one task, which confirms links on full
    sets. A pair is looked at in the first posting where it can meet, and pairs within the largest component not at all. A task names
    fewer links than it has members.
    """
    prefix = postings.groupBy("cls").agg(F.expr("bit_or(shiftleft(1L, coord))").alias("prefix"))
    known = comp.join(classes.select("cls", "n"), "cls")
    with_comp = postings.select("tok", "coord", "cls").join(known, "cls")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_MEMBERS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    spans = with_comp.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), blocks.alias("blocks")).where("lo != hi").select("tok", "blocks")
    open_ = with_comp.drop("n").join(spans, "tok").withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    open_ = open_.join(prefix, "cls").join(classes.select("cls", "sig", "n", "shared"), "cls").join(sets, "cls")
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("mine")).alias("p"), F.greatest(b, F.col("mine")).alias("q")))
    columns = ["coord", "cls", "comp", "prefix", "sig", "n", "shared", "mine", "items"]
    dealt = open_.select("tok", *columns, F.explode(other).alias("pair")).select("tok", "pair.p", "pair.q", *columns)

    def run(table: pa.Table) -> pa.Table:
        u, v = links_of_block(table.combine_chunks(), matches, percent)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.groupBy("tok", "p", "q").applyInArrow(run, "u long, v long")


def links_of_block(table: pa.Table, matches: int, percent: int) -> tuple[list[int], list[int]]:
    """Links between the members of two blocks (or of one) of a posting that join components."""
    cls, label, mine, n, shared, prefix = (np.asarray(table.column(c).to_numpy()).copy() for c in ("cls", "comp", "mine", "n", "shared", "prefix"))
    below = np.int64((1 << table.column("coord")[0].as_py()) - 1)
    sig = np.array(table.column("sig").combine_chunks().flatten().to_numpy(), np.int32).reshape(-1, COORDINATES)
    halves = table.column("p")[0].as_py() != table.column("q")[0].as_py()
    values, counts = np.unique(label, return_counts=True)
    settled = label == values[counts.argmax()]
    place = np.arange(len(cls))
    flat = off = mark = None
    us: list[int] = []
    vs: list[int] = []
    for i in np.flatnonzero(~settled).tolist():
        js = place[(label != label[i]) & (settled | (place > i))]
        js = js[mine[js] != mine[i]] if halves else js
        most = np.minimum(shared[js], shared[i])
        js = js[100 * most >= percent * (n[js] + n[i] - most)]
        if len(js) == 0:
            continue
        equal = sig[js] == sig[i]
        good = equal.sum(axis=1) >= matches
        js, equal = js[good], equal[good]
        bits = (equal.astype(_U64) << np.arange(COORDINATES, dtype=_U64)).sum(axis=1, dtype=_U64).view(np.int64)
        js = js[(bits & prefix[js] & prefix[i] & below) == 0]
        if len(js) == 0:
            continue
        if flat is None:  # numbers of the shingles, only where some pair has to be confirmed
            data, off = utf8_buffers(table.column("items").combine_chunks())
            off = off // 8
            names, flat = np.unique(data.view(_U64), return_inverse=True)
            mark = np.zeros(len(names), bool)
        own = flat[off[i] : off[i + 1]]
        mark[own] = True
        sizes = off[js + 1] - off[js]
        common = np.add.reduceat(mark[flat[ranges(off[js], sizes)]].astype(np.int64), np.cumsum(sizes) - sizes)
        mark[own] = False
        for j in js[100 * common >= percent * (sizes + len(own) - common)].tolist():
            if label[j] != label[i]:
                us.append(int(cls[i]))
                vs.append(int(cls[j]))
                label[label == label[j]] = label[i]
    return us, vs


def _grouped(texts: DataFrame, percent: int, matches: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id`` of every row."""
    signed = materialize(signed_docs(texts), "signed", FILES)
    # min over structs: equal keys mean equal sets, so the signature is any member's
    classes = signed.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "sig")).alias("m")).select(F.monotonically_increasing_id().alias("cls"), "k1", "k2", "m.doc_id", "m.sig")
    classes = materialize(classes, "classes", FILES)
    every = materialize(shared_postings(classes, matches), "postings", FILES)
    sets = materialize(class_sets(texts, classes.select("cls", "doc_id", "k1", "k2").join(every.select("cls").distinct(), "cls", "left_semi")), "sets", FILES)
    able = materialize(bounded_classes(sets, percent), "able", FILES)
    postings = materialize(every.join(able.select("cls"), "cls"), "able-postings", FILES)
    few = materialize(classes.select("cls", "sig").join(able, "cls"), "able-signatures", FILES)
    links = materialize(confirm(similar_pairs(star_pairs(postings), few, matches, percent), sets, percent), "links", FILES)

    def components(links: DataFrame) -> DataFrame:
        found = connected_components(links).select(F.col("node").alias("cls"), "component")
        return materialize(able.select("cls").join(found, "cls", "left").select("cls", F.coalesce("component", "cls").alias("comp")), "components", FILES)

    comp = components(links)
    rest = materialize(remaining_links(postings, comp, few, sets, matches, percent), "rest", FILES)
    if not rest.isEmpty():
        comp = components(links.unionByName(rest))
    discard(every, sets, postings, few, links, rest)
    named = classes.select("cls", "doc_id").join(comp, "cls")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = comp.join(least, "comp").select("cls", "least")
    by_key = classes.select("k1", "k2", "cls", F.col("doc_id").alias("own")).join(groups, "cls", "left").select("k1", "k2", F.coalesce("least", "own").alias("least"))
    out = signed.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "k1", "k2").join(by_key, ["k1", "k2"], "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicate_groups(docs: DataFrame, percent: int = 85, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document: its set's size, the least id it is linked to through any chain (itself
    included), and whether that is its own."""
    found = _grouped(docs_text(docs, id_col, text_col), percent, matches)
    return narrow(found.select("doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept")))


def drop_copies(docs: DataFrame, percent: int = 85, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those whose component has a lesser id; a row is told by its id and its text, and stays if it has no id."""
    found = _grouped(docs_text(docs, id_col, text_col), percent, matches)
    gone = found.where("component_id != doc_id").select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    mine = (F.col(f"`{id_col}`").cast("long") == F.col("_gone_id")) & (F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))) == F.col("_gone_key"))
    return narrow(docs.join(gone, mine, "left_anti"))
