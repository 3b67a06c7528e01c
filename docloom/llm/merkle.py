"""Merkle manifest of a dataset: a digest for each row, group and the whole, with a proof for every row.

Leaves are range-sorted by group and order. Every range partition builds the subtrees that lie wholly inside it, which needs no more than
one number a partition: how many leaves its first group has in earlier partitions (later groups begin in it), and for its first and last group
how many they have in all. Nodes whose run of ``FAN`` siblings crosses a border are shuffled by coordinate (group, level, place), level by level
up to the group's digest; their paths go back to the partition they came from, where proofs are put together. The groups' digests
are leaves of a second tree of the same kind.

Inside a group, leaves ascend by the order columns; while more than one node remains, every ``FAN`` consecutive ones (the last run: fewer, even
one) become their digest. The driver holds one row for each partition, and nothing else.

Defined results: nulls are digested as ``-``, in the group as a group of its own that comes first, in the order as the least; rows that tie in the order
ascend by their digest, and equal ones stand side by side, each with its own proof; a very long text is digested where it is read and goes no further;
a group of any size is split over partitions; an empty table gives an empty table; only the columns named take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize, narrow, parts_of, range_sorted

FAN = 16
#: Leaves of a range partition, about; a task holds their digests.
ROWS = 1 << 17
STEP = "struct<before:string,after:string>"


def digest(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the columns one after another, each ``-`` if null, else its UTF-8 length in bytes, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The digest that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof in one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Span:
    """Consecutive leaves of a group, from place ``start`` of ``total``, with all nodes whose run lies inside."""

    def __init__(self, leaves: list[str], start: int, total: int):
        self.levels: list[tuple[int, list[str], int, int, int]] = []  # first place, nodes, nodes of the level in all, parents built here: from, to
        nodes, first, n = leaves, start, total
        while True:
            end = first + len(nodes)
            low, high = -(-first // FAN), (-(-n // FAN) if end == n else end // FAN)
            if n == 1 or high <= low:
                self.levels.append((first, nodes, n, 0, 0))
                break
            self.levels.append((first, nodes, n, low, high))
            nodes = [_hash("".join(nodes[FAN * p - first : FAN * (p + 1) - first])) for p in range(low, high)]
            first, n = low, -(-n // FAN)

    def ragged(self) -> Iterator[tuple[int, int, str]]:
        """(level, place, digest) of nodes without a parent here, the group's own digest among them."""
        for level, (first, nodes, _, low, high) in enumerate(self.levels):
            for i, node in enumerate(nodes, first):
                if not low <= i // FAN < high:
                    yield level, i, node

    def paths(self, above: dict[tuple[int, int], tuple]) -> list[tuple]:
        """The way from each leaf upwards as (before, after) steps; ``above`` has the ways of ragged nodes."""
        ways: list[tuple] = []
        for level in reversed(range(len(self.levels))):
            first, nodes, _, low, high = self.levels[level]
            upper, ways = ways, []
            joined, at = "", -1
            for i in range(first, first + len(nodes)):
                parent = i // FAN
                if not low <= parent < high:
                    ways.append(above[level, i])
                    continue
                if parent != at:
                    at, joined = parent, "".join(nodes[FAN * parent - first : FAN * (parent + 1) - first])
                place = 64 * (i - FAN * parent)
                ways.append(((joined[:place], joined[place + 64 :]), *upper[parent - low]))
        return ways


def _spans(table: pa.Table, facts: tuple[int, int, int]) -> Iterator[tuple[str, int, int, Span]]:
    """(group, from, to, nodes) for the runs of one group in a part's rows; ``facts``: places before the first run, leaves of its group and of the last run's."""
    groups = table.column("g").combine_chunks()
    n = len(groups)
    leaves = table.column("digest").to_pylist()
    names = groups.dictionary_encode()
    codes = names.indices.to_numpy()
    cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), n]
    before, first_total, last_total = facts
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        total = first_total if k == 0 else last_total if b == n else b - a
        yield names.dictionary[int(codes[a])].as_py(), a, b, Span(leaves[a:b], before if k == 0 else 0, total)


def partition_facts(ranged: DataFrame) -> tuple[list[tuple[int, int, int]], int]:
    """For each part: leaves of its first group in earlier parts, leaves of its first and of its last group in all; and the greatest group's leaves."""
    counts = ranged.groupBy("part", "g").agg(F.count(F.lit(1)).alias("n"))
    mark = lambda end: F.struct(F.xxhash64(end["g"]), F.sha2(end["g"], 256), end["n"].alias("n"))
    ends = counts.groupBy("part").agg(F.min(F.struct("g", "n")).alias("lo"), F.max(F.struct("g", "n")).alias("hi"), F.max("n").alias("most"))
    rows = ends.select("part", mark(F.col("lo")).alias("lo"), mark(F.col("hi")).alias("hi"), "most").orderBy("part").collect()  # one a part
    chains: list[list] = []  # group's mark, leaves so far
    found = {}
    for r in rows:
        lo, hi = tuple(r["lo"]), tuple(r["hi"])
        if not chains or chains[-1][0] != lo[:2]:
            chains.append([lo[:2], 0])
        first, before = len(chains) - 1, chains[-1][1]
        chains[-1][1] += lo[2]
        if hi[:2] != lo[:2]:
            chains.append([hi[:2], hi[2]])
        found[r["part"]] = (before, first, len(chains) - 1)
    facts = [(0, 0, 0)] * (max(found, default=-1) + 1)
    for part, (before, first, last) in found.items():
        facts[part] = (before, chains[first][1], chains[last][1])
    return facts, max([0, *(n for _, n in chains), *(r["most"] for r in rows)])


NODES = "part int, g string, total long, level int, place long, digest string"


class Forest:
    """A tree for each group of a table ``g, digest, row`` and order columns; ``row`` is what comes back with the proofs."""

    def __init__(self, leaves: DataFrame, order: list[str], name: str):
        n_rows = leaves.count()
        self.name = name
        self.ranged = range_sorted(leaves, ["g", *order], name, n_rows, ROWS)
        self.facts, largest = partition_facts(self.ranged)
        self.shared = leaves.sparkSession.sparkContext.broadcast(self.facts)  # three numbers a partition
        self.height = 0
        while FAN**self.height < largest:
            self.height += 1
        self.nodes = materialize(self._ragged(), f"{name}-nodes", 1)
        self._finish()

    def _by_part(self, rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartitionById(max(1, len(self.facts)), "part").sortWithinPartitions("part", *order)

    def _ragged(self) -> DataFrame:
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, table in parts_of(batches):
                rows = [(part, g, span.levels[0][2], *node) for g, _, _, span in _spans(table, shared.value[part]) for node in span.ragged()]
                for a in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[a : a + 10_000], strict=True))
                    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in NODES.split(", ")])

        return self._by_part(self.ranged.select("part", "at", "g", "digest"), "at").select("part", "g", "digest").mapInArrow(run, NODES)

    def _finish(self) -> None:
        """Levels over partition borders: upwards by coordinate to the groups' digests, then the ways back down."""
        made = None
        runs, tops = [], []
        crossing = not self.nodes.where(F.col("total") > F.pow(F.lit(float(FAN)), F.col("level"))).isEmpty()
        for level in range(self.height + 1):
            now = self.nodes.where(F.col("level") == level).select("g", "total", "place", "digest")
            now = now.unionByName(made) if made is not None else now
            tops.append(now.where(F.col("total") <= FAN**level).select("g", "digest"))
            made = None
            if crossing and level < self.height:
                run = now.where(F.col("total") > FAN**level).groupBy("g", "total", F.expr(f"place div {FAN}").alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "digest")))["digest"].alias("run"))
                run = materialize(run.withColumn("digest", F.sha2(F.array_join("run", ""), 256)), f"{self.name}-level", 1)
                runs.append(run)
                made = run.select("g", "total", "place", "digest")
        roots = tops[0]
        for more in tops[1:]:
            roots = roots.unionByName(more)
        self.roots = materialize(roots, f"{self.name}-roots", 1)
        none = F.array().cast(f"array<{STEP}>")
        ways: list[DataFrame] = []
        upper = None
        for level in reversed(range(len(runs))):
            run = runs[level].select("g", "place", "run")
            run = run.join(upper, ["g", "place"], "left").withColumn("way", F.coalesce("way", none)) if upper is not None else run.withColumn("way", none)
            step = F.struct(F.array_join(F.slice("run", F.lit(1), F.col("i")), "").alias("before"), F.array_join(F.slice("run", F.col("i") + 2, F.lit(FAN)), "").alias("after"))
            child = run.select("g", "place", "run", "way", F.posexplode("run").alias("i", "_")).select("g", (F.col("place") * FAN + F.col("i")).alias("place"), F.concat(F.array(step), "way").alias("way"))
            upper = materialize(child, f"{self.name}-ways", 1)
            ways.append(upper.withColumn("level", F.lit(level)))
        found = self.nodes
        if ways:
            every = ways[0]
            for more in ways[1:]:
                every = every.unionByName(more)
            found = found.join(every, ["g", "level", "place"], "left").withColumn("way", F.coalesce("way", none))
        else:
            found = found.withColumn("way", none)
        self.found = found.select("part", "g", "level", "place", "way")

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """``row, digest, subroot, root, proof`` of every leaf; ``above`` has ``g, subroot, root, way`` of the tree over groups."""
        own = self.roots.select("g", F.col("digest").alias("subroot"))
        top = own.select("g", "subroot", F.col("subroot").alias("root")) if above is None else above.select("g", "subroot", "root", F.col("way").alias("last"))
        found = self.found.join(top, "g")
        found = found if above is None else found.withColumn("way", F.concat("way", "last"))
        kind = self.ranged.schema["row"].dataType.simpleString()
        heads = found.select("part", F.lit(-1).cast("long").alias("at"), "g", F.lit(None).cast("string").alias("digest"), F.lit(None).cast(kind).alias("row"), F.struct("level", "place", "subroot", "root", "way").alias("head"))
        leaves = self.ranged.select("part", "at", "g", "digest", "row", F.lit(None).cast(heads.schema["head"].dataType).alias("head"))
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, table in parts_of(batches):
                at = table.column("at").to_numpy()
                n_heads = int(np.searchsorted(at, 0))
                above: dict[str, dict] = {}
                for g, h in zip(table.column("g").slice(0, n_heads).to_pylist(), table.column("head").slice(0, n_heads).to_pylist(), strict=True):
                    above.setdefault(g, {})[h["level"], h["place"]] = (*((s["before"], s["after"]) for s in h["way"]), (h["subroot"], h["root"]))
                own = table.slice(n_heads).select(["g", "digest", "row"])
                for g, a, b, span in _spans(own, shared.value[part]):
                    ways = span.paths(above[g])
                    for x in range(a, b, 500):
                        y = min(b, x + 500)
                        yield _proof_batch(own.slice(x, y - x), ways[x - a : y - a])

        out = f"row {kind}, digest string, subroot string, root string, proof array<{STEP}>"
        return self._by_part(leaves.unionByName(heads), "at").mapInArrow(run, out)

    def discard(self) -> None:
        discard(self.ranged, self.nodes)


def _proof_batch(own: pa.Table, ways: list[tuple]) -> pa.RecordBatch:
    own = own.combine_chunks()
    steps = [s for w in ways for s in w[:-1]]
    ends = np.cumsum([0, *(len(w) - 1 for w in ways)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.string())], ["before", "after"])
    tops = [pa.array([w[-1][i] for w in ways], pa.string()) for i in (0, 1)]
    one = lambda c: own.column(c).chunk(0)
    return pa.RecordBatch.from_arrays([one("row"), one("digest"), *tops, pa.ListArray.from_arrays(ends, pairs)], ["row", "digest", "subroot", "root", "proof"])


def manifest(rows: DataFrame, leaf: Column, group: Column, order: list[Column], carried: dict[str, Column]) -> DataFrame:
    """``carried``, ``leaf, subroot, root, proof`` of every row: its digest, its group's and the table's, and the siblings on its way to the root.

    ``proof`` has a step for each level with the digests before and after the node in its run; ``fold`` leads from a leaf and its proof to the root.
    """
    bound_batches(rows.sparkSession)
    names = [f"o{i}" for i in range(len(order))]
    own = rows.select(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("g"), leaf.alias("digest"), *[c.alias(n) for c, n in zip(order, names, strict=True)], F.monotonically_increasing_id().alias("r"), F.struct(*[c.alias(n) for n, c in carried.items()]).alias("row"))
    leaves = materialize(own, "leaves")
    trees = Forest(leaves, [*names, "digest", "r"], "sorted-leaves")
    discard(leaves)
    top = Forest(trees.roots.select(F.lit("").alias("g"), F.col("g").alias("o0"), "digest", F.struct("g").alias("row")), ["o0"], "sorted-groups")
    groups = materialize(top.proofs().select("row.g", F.col("digest").alias("subroot"), "root", F.col("proof").alias("way")), "groups", 1)
    return narrow(trees.proofs(groups)).select(*[F.col(f"row.`{n}`").alias(n) for n in carried], F.col("digest").alias("leaf"), "subroot", "root", "proof")
