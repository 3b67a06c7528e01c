"""Pruned BM25 retrieval: the best rows of a whole corpus for many questions, without scoring every pair.

The corpus is read once. Each batch of rows becomes a shard of postings (term, row, count) of the tokens that questions hold, written to the shared
folder; document frequencies and mean lengths are sums over shards. In a shard rows stand in order of length, cut into blocks, and each
term knows its greatest impact in every block it occurs in. Two passes over the shards answer all questions:

1. A threshold for each question: the rows of a shard that its rarest terms favour are scored in full, and the ``top``-th best of all shards' scores is a lower
   bound of what the last place needs.
2. Terms go by falling greatest impact. A block in which the terms still to come cannot reach the threshold is skipped, a row enters only where they can, and leaves
   as soon as what it has and the block's greatest rest fall short. Rows that stay are scored in full; a shard names at most ``top`` of them for a question.

What is shuffled is thus shards times questions times ``top`` rows at most, and the answer is that of scoring everything. Questions are handled in packs
whose distinct tokens fit a broadcast of ``PACK_TOKENS``; each pack reads the corpus once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import profiles as P
from docloom.sources.shared import bound_batches, give_back_memory, stored

#: Distinct tokens of the questions of a pack, at most (but for a pack of one question).
PACK_TOKENS = 200_000
#: Rows of a shard, about, and of a block in it.
SHARD_ROWS, BLOCK_ROWS = 16_384, 64
#: Postings of a shard and tokens of a part of it, about: what a task holds does not grow with the corpus nor with the length of its texts.
SHARD_POSTINGS, PART_TOKENS = 400_000, 200_000
#: Rows of a shard that the rarest terms of a question may bring up for its threshold, as a share; and how many of those are scored.
RARE_SHARE, FIRST_ROWS = 0.05, 64
#: Scores are rounded to four digits before they are ranked; so much below the threshold may still tie with it.
SLACK = 1.01e-4

INDEX = "lengths binary, term binary, row binary, tf binary"


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that all fields of one have about ``PART_TOKENS`` tokens (one row at least)."""
    for batch in batches:
        sizes = sum(np.asarray(pc.fill_null(pc.list_value_length(c), 0), np.int64) for c in batch.columns[1:])
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART_TOKENS, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def index_shards(rows: DataFrame, key: str, fields: dict[str, Column], tokens: list[str]) -> DataFrame:
    """``keys`` and ``INDEX``: for each batch of rows the postings of ``tokens`` in every field; term = field * len(tokens) + token."""
    bound_batches(rows.sparkSession)
    wanted = rows.sparkSession.sparkContext.broadcast(tokens)  # at most PACK_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(wanted.value, pa.string())
        for batch in _parts(batches):
            n = batch.num_rows
            if n == 0:
                continue
            lengths, terms, at = [], [], []
            for f, column in enumerate(batch.columns[1:]):
                sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
                ids = pc.index_in(column.flatten(), value_set=names) if len(names) else pa.nulls(int(sizes.sum()), pa.int32())
                known = np.asarray(pc.is_valid(ids))
                terms.append(np.asarray(pc.fill_null(ids, 0), np.int64)[known] + f * len(names))
                at.append(np.repeat(np.arange(n), sizes)[known])
                lengths.append(sizes)
            both, tf = np.unique(np.concatenate(terms) * n + np.concatenate(at), return_counts=True)
            keys = pa.ListArray.from_arrays(np.array([0, n], np.int32), pa.concat_arrays([batch.column(0)]))
            blobs = [np.concatenate(lengths).astype("<i4"), (both // n).astype("<u4"), (both % n).astype("<u4"), tf.astype("<u4")]
            yield pa.RecordBatch.from_arrays([keys, *[pa.array([b.tobytes()], pa.binary()) for b in blobs]], ["keys", *[c.split()[0] for c in INDEX.split(", ")]])
        give_back_memory()

    asked = rows.select(F.col(key), *[c.alias(f"f{i}") for i, c in enumerate(fields.values())])
    return asked.mapInArrow(run, f"keys array<{_kind(rows, key)}>, {INDEX}")


def corpus_counts(index: DataFrame, n_terms: int, n_fields: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Document frequency of each term, the number of rows, and each field's mean length; summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, sums = np.zeros(n_terms, np.int64), np.zeros(1 + n_fields, np.int64)
        for batch in batches:
            for lengths, term in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(lengths.as_buffer(), "<i4").reshape(n_fields, -1)
                df += np.bincount(np.frombuffer(term.as_buffer(), "<u4"), minlength=n_terms)
                sums += [own.shape[1], *own.sum(axis=1)]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, -1 - np.arange(1 + n_fields)])), pa.array(np.concatenate([df[some], sums]))], ["id", "n"])

    df, sums = np.zeros(n_terms, np.int64), np.zeros(1 + n_fields, np.int64)
    for r in index.select("lengths", "term").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # one for each term and field
        (df if r["id"] >= 0 else sums)[r["id"] if r["id"] >= 0 else -1 - r["id"]] = r["n"]
    return df, int(sums[0]), sums[1:] / max(int(sums[0]), 1)


class Shard:
    """Postings of some rows, in order of length, with the greatest impact of each term in each block."""

    def __init__(self, parts: list[tuple], n_fields: int, weights: np.ndarray, means: np.ndarray):
        self.keys = pa.concat_arrays([p[0] for p in parts])
        n = self.n = len(self.keys)
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        lengths = np.concatenate([p[1].reshape(n_fields, -1) for p in parts], axis=1)
        term = np.concatenate([p[2] for p in parts]).astype(np.int64)
        row = np.concatenate([p[3] + b for p, b in zip(parts, base, strict=False)]).astype(np.int64)
        tf = np.concatenate([p[4] for p in parts]).astype(np.float64)
        self.order = np.argsort(lengths.sum(axis=0), kind="stable")
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        field = term // max(1, len(weights) // n_fields)
        norm = tf + P.BM25_K1 * (1.0 - P.BM25_B + P.BM25_B * lengths[field, row] / np.maximum(means[field], 1.0))
        impact = weights[term] * tf * (P.BM25_K1 + 1.0) / norm
        row = place[row]
        order = np.argsort(term * n + row)
        self.term, self.row, self.impact = term[order], row[order], impact[order]
        block = self.row // BLOCK_ROWS
        new = np.ones(len(self.term) + 1, bool)
        new[1:-1] = (self.term[1:] != self.term[:-1]) | (block[1:] != block[:-1])
        cuts = np.flatnonzero(new)
        self.run_first = cuts  # and the end
        self.run_block, self.run_term = block[cuts[:-1]], self.term[cuts[:-1]]
        self.run_most = np.maximum.reduceat(self.impact, cuts[:-1]) if len(self.impact) else self.impact
        self.n_blocks = -(-n // BLOCK_ROWS)
        self.read = self.entered = self.completed = 0

    def _postings(self, term: int) -> slice:
        return slice(*np.searchsorted(self.term, [term, term + 1]))

    def first_scores(self, terms: np.ndarray, df: np.ndarray, top: int) -> np.ndarray:
        """Full scores of the rows that the rarest terms favour, the best ``top`` of them."""
        partial: dict[int, float] = {}
        room = RARE_SHARE * self.n
        for t in terms[np.argsort(df[terms], kind="stable")].tolist():
            own = self._postings(t)
            room -= own.stop - own.start
            if partial and room < 0:
                break
            for r, x in zip(self.row[own].tolist(), self.impact[own].tolist(), strict=True):
                partial[r] = partial.get(r, 0.0) + x
        rows = np.sort(np.array(sorted(partial, key=lambda r: -partial[r])[: max(FIRST_ROWS, top)], np.int64))
        scores = np.zeros(len(rows))
        for t in terms.tolist() if len(rows) else ():
            own = self._postings(t)
            there = self.row[own]
            at = np.minimum(np.searchsorted(there, rows), max(len(there) - 1, 0))
            if len(there):
                scores += np.where(there[at] == rows, self.impact[own][at], 0.0)
        return np.sort(scores)[::-1][:top]

    def best(self, terms: np.ndarray, least: float, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and full scores of the ``top`` best that reach ``least``, ties by key."""
        runs = [np.arange(*np.searchsorted(self.run_term, [t, t + 1])) for t in terms.tolist()]
        runs = [r for r in runs if len(r)]
        runs.sort(key=lambda r: -self.run_most[r].max())
        rest = np.zeros((len(runs) + 1, self.n_blocks))  # what terms from here on can give in a block
        for i in range(len(runs) - 1, -1, -1):
            rest[i] = rest[i + 1]
            rest[i, self.run_block[runs[i]]] += self.run_most[runs[i]]
        score = np.zeros(self.n)
        inside = np.zeros(self.n, bool)
        held = np.zeros(self.n_blocks, np.int64)  # rows inside, by block
        for i, own in enumerate(runs):
            may = rest[i] >= least
            own = own[(may | (held > 0))[self.run_block[own]]]  # other blocks are skipped
            if len(own) == 0:
                continue
            a, sizes = self.run_first[own], self.run_first[own + 1] - self.run_first[own]
            at = np.arange(int(sizes.sum())) + np.repeat(a - np.cumsum(sizes) + sizes, sizes)
            self.read += len(at)
            row = self.row[at]
            take = inside[row] | may[row // BLOCK_ROWS]
            row = row[take]
            fresh = row[~inside[row]]
            self.entered += len(fresh)
            inside[fresh] = True
            score[row] += self.impact[at[take]]
            now = np.flatnonzero(inside)
            out = now[score[now] + rest[i + 1][now // BLOCK_ROWS] < least]
            inside[out] = False
            score[out] = -np.inf  # what comes later is not enough, and a row does not come back
            held = np.bincount(np.flatnonzero(inside) // BLOCK_ROWS, minlength=self.n_blocks)
        rows = np.flatnonzero(inside)
        self.completed += len(rows)
        value = score[rows]
        if len(rows) > top:
            rounded = np.floor(value * 1e4 + 0.5)
            some = rounded >= np.partition(rounded, -top)[-top]
            rows, value, rounded = rows[some], value[some], rounded[some]
            names = np.array(self.keys.take(pa.array(self.order[rows])).to_pylist(), object)
            first = sorted(range(len(rows)), key=lambda j: (-rounded[j], names[j] is not None, names[j]))[:top]
            rows, value = rows[first], value[first]
        return self.order[rows], value


class Searcher:
    """What every task needs of a pack of questions: their terms, document frequencies, impacts' weights."""

    def __init__(self, qids: pa.Array, terms: list[np.ndarray], df: np.ndarray, weights: np.ndarray, means: np.ndarray, n_fields: int):
        self.qids, self.terms, self.df, self.weights, self.means, self.n_fields = qids, terms, df, weights, means, n_fields

    def shards(self, batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        parts, n, postings = [], 0, 0
        for batch in batches:
            for keys, lengths, term, row, tf in zip(*batch.columns, strict=True):
                parts.append((keys.values, np.frombuffer(lengths.as_buffer(), "<i4"), *(np.frombuffer(x.as_buffer(), "<u4") for x in (term, row, tf))))
                n, postings = n + len(keys.values), postings + len(parts[-1][2])
                if n >= SHARD_ROWS or postings >= SHARD_POSTINGS:
                    shard = Shard(parts, self.n_fields, self.weights, self.means)
                    parts, n, postings = [], 0, 0  # nothing of them is held beside the shard
                    yield shard
                    del shard
        if parts:
            yield Shard(parts, self.n_fields, self.weights, self.means)
        give_back_memory()


def _search_pack(qids: pa.Array, asked: list[np.ndarray], qid_kind: str, index: DataFrame, key: str, key_kind: str, n_tokens: int, weights: list[float], top: int, counters: dict | None) -> DataFrame:
    """Questions go by their place in the pack; a task names them itself, since a local frame of names would cost each core a Python worker of its own, which stays."""
    spark = index.sparkSession
    n_fields = len(weights)
    df, n_rows, means = corpus_counts(index, n_tokens * n_fields, n_fields)
    factor = np.repeat(np.array(weights), n_tokens) * np.log(1.0 + (n_rows - df + 0.5) / (df + 0.5))
    terms = [np.concatenate([ids + f * n_tokens for f in range(n_fields)]) for ids in asked]
    terms = [t[df[t] > 0] for t in terms]
    shared = spark.sparkContext.broadcast(Searcher(qids, terms, df, factor, means, n_fields))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for shard in s.shards(batches):
            found = [(i, x) for i, t in enumerate(s.terms) for x in shard.first_scores(t, s.df, top).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], ["q", "score"])

    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    bounds = index.mapInArrow(first, "q long, score double").withColumn("nth", nth).where(F.col("nth") == top)
    least = np.full(len(asked), 1e-12)  # any shared token
    for r in bounds.select("q", "score").collect():  # one a question of the pack
        least[r["q"]] = max(r["score"] - SLACK, 1e-12)
    bound = spark.sparkContext.broadcast(least)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for shard in s.shards(batches):
            qs, at, scores = [], [], []
            for i, t in enumerate(s.terms):
                rows, value = shard.best(t, bound.value[i], top)
                qs.append(np.full(len(rows), i))
                at.append(rows)
                scores.append(value)
            if counters:
                for name, counter in counters.items():
                    counter.add(getattr(shard, name))
            q = np.concatenate(qs) if qs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([s.qids.take(pa.array(q, pa.int64())), shard.keys.take(pa.array(np.concatenate(at) if at else q, pa.int64())), pa.array(np.concatenate(scores) if scores else q, pa.float64())], ["qid", "key", "score"])

    return index.mapInArrow(second, f"qid {qid_kind}, key {key_kind}, score double").withColumnRenamed("key", key)


def search(questions: DataFrame, rows: DataFrame, key: str, fields: dict[str, Column], weights: dict[str, float], question_tokens: Column, top: int = P.TOP_CHUNKS, counters: dict | None = None) -> DataFrame:
    """``qid``, ``key``, ``score, rank``: the ``top`` best rows for every question by BM25 over weighted ``fields`` (arrays of tokens).

    Scores have four digits; ties go to the lesser key. Rows that share no token with a question are not ranked. ``counters`` may hold accumulators named ``read``
    (postings), ``entered`` and ``completed`` (pairs of question and row), for measurements.
    """
    asked = stored(questions.select("qid", F.array_distinct(F.coalesce(question_tokens, F.array().cast("array<string>"))).alias("tokens")), "asked")
    n_tokens = asked.select(F.explode("tokens").alias("t")).agg(F.approx_count_distinct("t")).first()[0]
    packs = max(1, -(-int(1.1 * n_tokens) // PACK_TOKENS))
    found = None
    for i in range(packs):
        pack = asked.where(F.pmod(F.xxhash64("qid"), F.lit(packs)) == i).toArrow()  # a pack is bounded by its tokens
        names = {t: n for n, t in enumerate(sorted(set(pc.list_flatten(pack["tokens"]).to_pylist())))}
        ids = [np.array([names[t] for t in ts], np.int64) for ts in pack["tokens"].to_pylist()]
        index = stored(index_shards(rows, key, fields, list(names)), "index")
        part = _search_pack(pa.array(pack["qid"].to_pylist(), pack["qid"].type), ids, _kind(asked, "qid"), index, key, _kind(rows, key), len(names), [weights[f] for f in fields], top, counters)
        found = part if found is None else found.unionByName(part)
    found = found.withColumn("score", F.round("score", 4))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)
