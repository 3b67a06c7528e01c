"""Merging, deduplicating and annotating chunks; keyed overlays of tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom import profiles as P
from docloom.functions.text import any_of, strings, strip
from docloom.sources.shared import stored

CHUNK_FIELDS = ["chunk_id", "doc_id", "title", "domain", "page_no", "section_path", "chunk_type", "clause_no", "chunk_text"]


def chunk_index(chunk_id: Column) -> Column:
    return F.coalesce(F.regexp_extract(chunk_id, r"chunk-(\d+)$", 1).try_cast("int"), F.lit(0))


def clean_noise(chunks: DataFrame) -> DataFrame:
    """Without the remains of page controls; ``noise_removed`` tells whether a text changed."""
    out = F.col("chunk_text")
    for pattern in P.WEB_NOISE:
        out = F.regexp_replace(out, pattern, "")
    out = strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))
    return chunks.withColumn("cleaned", out).withColumn("noise_removed", F.col("cleaned") != F.col("chunk_text")).withColumn("chunk_text", F.col("cleaned")).drop("cleaned")


# ------------------------------------------------------------------ neighbours
def _may_join(a: dict, b: dict) -> bool:
    """Whether ``b`` joins what its predecessors have become; a missing kind, page or text joins nothing."""
    if None in (a["chunk_type"], b["chunk_type"], a["page_no"], b["page_no"], a["chunk_text"], b["chunk_text"]) or b["opens"]:
        return False
    text_a, text_b = len(a["chunk_text"]), len(b["chunk_text"])
    sections = not a["section_path"] or not b["section_path"] or a["section_path"] == b["section_path"]
    tables = a["chunk_type"] == "table" or b["chunk_type"] == "table"
    near = abs(a["page_no"] - b["page_no"]) <= 1
    small = text_a < P.MERGE_MIN or text_b < P.MERGE_MIN
    return not tables and near and sections and text_a + text_b <= P.MAX_CHUNK and small


def _joined(a: dict, b: dict) -> dict:
    first = lambda c: a[c] if a[c] else b[c]
    kind = "clause" if "clause" in (a["chunk_type"], b["chunk_type"]) else first("chunk_type")
    made = {"page_no": min(a["page_no"], b["page_no"]), "section_path": first("section_path"), "chunk_type": kind, "clause_no": first("clause_no"), "chunk_text": (a["chunk_text"] + "\n" + b["chunk_text"])[: P.MAX_CHUNK]}
    return a | made | {"n_merged": a["n_merged"] + 1}


def _never_joins(a: dict, b: dict) -> bool:
    """Whether ``b`` stays apart whatever ``a``, the chunk before it, has become: texts only grow, pages only fall, a section once known stays."""
    if a["doc_id"] != b["doc_id"] or b["opens"] or None in (a["chunk_type"], b["chunk_type"], a["page_no"], b["page_no"], a["chunk_text"], b["chunk_text"]):
        return True
    size_a, size_b = len(a["chunk_text"]), len(b["chunk_text"])
    sections = bool(a["section_path"] and b["section_path"] and a["section_path"] != b["section_path"])
    return "table" in (a["chunk_type"], b["chunk_type"]) or b["page_no"] > a["page_no"] + 1 or sections or size_a + size_b > P.MAX_CHUNK or min(size_a, size_b) >= P.MERGE_MIN


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield from batch.slice(at, 500).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    done: list[dict] = []
    for row in rows:
        done.append(row)
        if len(done) == most:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


#: What the first fold knows of a row: nothing came before it in the task that settles it, it is whole, or the next task may add to it.
HEAD, WHOLE, OPEN = 0, 1, 2


def _fold_part(rows: Iterator[dict], part: int) -> Iterator[dict]:
    """The chunks of one range of the sorted table. Rows before the first certain break depend on the range before and stay as they are."""
    before, last = None, None
    for at, x in enumerate(rows):
        x |= {"part": part, "at": at, "n_merged": 0, "chunk_ord": 0, "kind": HEAD}
        if last is None and (before is None or not _never_joins(before, x)):
            yield x
        elif last is not None and last["doc_id"] == x["doc_id"] and _may_join(last, x):
            last = _joined(last, x)
        else:
            if last is not None:
                yield last | {"kind": WHOLE}
                x["chunk_ord"] = last["chunk_ord"] + 1 if last["doc_id"] == x["doc_id"] else 0
            last = x
        before = x
    if last is not None:
        yield last | {"kind": OPEN}


def _fold_border(rows: Iterator[dict]) -> Iterator[dict]:
    """Open chunks with the heads that follow them, in order of (``chain, part, at``)."""
    last, part, n = None, None, 0
    for x in rows:
        if last is not None and last["chain"] == x["chain"] and last["doc_id"] == x["doc_id"] and x["kind"] == HEAD and _may_join(last, x):
            last = _joined(last, x)
            continue
        if last is not None:
            yield last
        if x["kind"] == HEAD:  # heads of a range are of one document: they count from nought, the range's other chunks after them
            part, n = x["part"], n + 1 if part == x["part"] else 0
            x["chunk_ord"] = n
        last = x
    if last is not None:
        yield last


def merge_neighbours(chunks: DataFrame, profile: P.ChunkProfile = P.FINANCE) -> DataFrame:
    """Small neighbours of a document joined from left to right; each is held against what its predecessors have become.

    The table is sorted by range, so a large document lies in several tasks. A fold needs to know what came before, but not behind a certain
    break (another document, a boundary, a table, a page or section that cannot fit, texts too large together or both large enough): a task folds all from
    its first such break on with one open chunk in memory. What crosses a border, the last chunk of a range and the rows before the next one's first break, is
    folded afterwards; only a document without any certain break is one task there. Ordinals are counts in the range plus those of the ranges before.
    Adds ``n_merged``, how many chunks were joined to the first. Rows of one document with equal ids and ordinals go by their other columns; a null document counts as one.
    """
    inner = T.StructType([chunks.schema[c] for c in CHUNK_FIELDS]).add("opens", T.BooleanType()).add("n_merged", T.IntegerType()).add("chunk_ord", T.LongType())
    inner = inner.add("part", T.IntegerType()).add("at", T.LongType()).add("kind", T.IntegerType())
    ordered = chunks.select(*CHUNK_FIELDS, chunk_index(F.col("chunk_id")).alias("n"), "chunk_ord", strip(F.col("chunk_text")).rlike(profile.boundary).alias("opens"))
    ordered = ordered.repartitionByRange("doc_id", "n", "chunk_ord").sortWithinPartitions("doc_id", "n", "chunk_ord", *CHUNK_FIELDS)
    arrow = to_arrow_schema(inner)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_fold_part(_rows(batches), TaskContext.get().partitionId()), arrow)

    folded = stored(ordered.mapInArrow(fold, inner), "neighbours")
    whole, border = folded.where(F.col("kind") == WHOLE), folded.where(F.col("kind") != WHOLE)
    # one row for each range of the table: the range whose open chunk its head continues
    parts = border.groupBy("part").agg(F.max(F.col("kind") == OPEN).alias("opened"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    chains = parts.select("part", F.coalesce(F.max(F.when(F.col("opened"), F.col("part"))).over(earlier), F.lit(-1)).alias("before"))
    linked = border.join(F.broadcast(chains), "part").withColumn("chain", F.when(F.col("kind") == OPEN, F.col("part")).otherwise(F.col("before"))).drop("before")
    outer = T.StructType([linked.schema[c] for c in linked.columns])
    arrow_outer = to_arrow_schema(outer)
    settled = stored(linked.repartition("chain").sortWithinPartitions("chain", "part", "at").mapInArrow(lambda batches: _batches(_fold_border(_rows(batches)), arrow_outer), outer), "settled")
    # documents that touch a border, at most two for each range; their counts by range
    touched = F.broadcast(settled.select(F.col("doc_id").alias("_doc")).distinct())
    counts = whole.select("doc_id", "part", "kind").join(touched, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi").unionByName(settled.select("doc_id", "part", "kind"))
    counts = counts.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == HEAD).alias("heads"))
    sum_before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = F.broadcast(counts.select(F.col("doc_id").alias("_doc"), F.col("part").alias("_part"), F.coalesce(sum_before, F.lit(0)).alias("_before"), F.col("heads").alias("_heads")))
    found = whole.unionByName(settled.select(*whole.columns)).join(places, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_part")), "left")
    shift = F.coalesce("_before", F.lit(0)) + F.when(F.col("kind") == HEAD, 0).otherwise(F.coalesce("_heads", F.lit(0)))
    return found.select(*CHUNK_FIELDS, "n_merged", (F.col("chunk_ord") + shift).alias("chunk_ord"))


def annotate_formulas(chunks: DataFrame) -> DataFrame:
    """Texts with percentages, multiples, amounts, divisions or wording of a formula get up to three tags in front; the whole stays within the limit."""
    text = F.col("chunk_text")
    tags = F.slice(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(t)) for p, t in P.FORMULA_TAGS])), 1, 3)
    prefix = F.array_join(tags, " ")
    marked = F.concat(prefix, F.lit(" "), F.substr(text, F.lit(1), P.MAX_CHUNK - F.length(prefix) - 1))
    return chunks.withColumn("chunk_text", F.when((F.size(tags) > 0) & ~F.startswith(text, F.lit("[公式]")), marked).otherwise(text))


# ------------------------------------------------------------------ duplicates
#: Unicode's white space as ranges, several times as fast as the property of the same name.
WHITE_SPACE = "[\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def template_key(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, WHITE_SPACE, "")


def _structural_key(key: Column) -> Column:
    short = F.length(key)
    return ((short < 40) & key.rlike(r"(?U)^202\d年度报告")) | ((short < 30) & key.rlike(r"(?U)^第[一二三四五六七八九十百千\d]+[章节点]"))


def is_structural(text: Column) -> Column:
    """A report's title alone or a chapter heading alone."""
    return _structural_key(template_key(text))


def dedup_templates(chunks: DataFrame) -> DataFrame:
    """Boilerplate stays once in the corpus: headings anywhere, and the standard phrases of penalty decisions in documents that hold one.

    Tables are never touched. The first of equal texts (white space aside) stays.
    """
    text = F.col("chunk_text")
    penalty = chunks.where(text.rlike(any_of(P.PENALTY_MARKERS))).select("doc_id").distinct().withColumn("penalty", F.lit(True))
    marked = chunks.join(penalty, "doc_id", "left")
    template = ~F.startswith(text, F.lit(P.TABLE_MARK)) & (is_structural(text) | (F.coalesce("penalty", F.lit(False)) & text.rlike(any_of(P.TEMPLATE_ANCHORS))))
    marked = marked.withColumn("template", template).drop("penalty")
    fixed, rest = marked.where("template"), marked.where("not template")
    # partial aggregation keeps a phrase shared by a third of all rows out of any one task
    firsts = fixed.groupBy(template_key(text).alias("key")).agg(F.min("chunk_ord").alias("chunk_ord")).select("chunk_ord")
    return rest.unionByName(fixed.join(firsts, "chunk_ord", "left_semi")).drop("template").select(*chunks.columns)


def keep_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, in the place of its first."""
    others = [c for c in rows.columns if c != order]
    kept = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("row"), F.min(order).alias(order))
    return kept.select("row.*", order)


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("row")).select("row.*")


def only_known(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")


def duplicate_report(chunks: DataFrame) -> DataFrame:
    """``scope, groups, surplus``: groups of equal texts and the rows beyond their first, by kind of template.

    Texts stand for themselves by a SHA-256 digest without white space, so no text is shuffled. Null texts form one group.
    """
    keyed = chunks.select("chunk_text", template_key(F.col("chunk_text")).alias("bare"))
    flagged = keyed.select(F.sha2("bare", 256).alias("key"), F.col("chunk_text").rlike(any_of(P.TEMPLATE_ANCHORS)).alias("penalty"), _structural_key(F.col("bare")).alias("structural"))
    counted = flagged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("penalty").alias("penalty"), F.max("structural").alias("structural")).where("n > 1")
    scopes = F.array_compact(F.array(F.lit("global"), F.when(F.col("penalty"), "penalty"), F.when(F.col("structural"), "boilerplate"), F.when(F.col("penalty") | F.col("structural"), "union")))
    return counted.select(F.explode(scopes).alias("scope"), "n").groupBy("scope").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("surplus"))


# ------------------------------------------------------------------ overlays of keyed tables
def merge_documents(local: DataFrame, base: DataFrame) -> DataFrame:
    """Local rows, and base rows with other ids."""
    return local.unionByName(base.join(local.select("doc_id").distinct(), "doc_id", "left_anti").select(*base.columns), allowMissingColumns=True)


def merge_chunk_tables(local: DataFrame, base: DataFrame) -> DataFrame:
    """Base rows whose document and chunk are both unknown locally, then local rows."""
    fresh = base.join(local.select("doc_id").distinct(), "doc_id", "left_anti").join(local.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return fresh.select(*base.columns).unionByName(local, allowMissingColumns=True)


def replace_documents(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """All rows of the documents that ``changed`` has come from it."""
    return rows.join(changed.select("doc_id").distinct(), "doc_id", "left_anti").select(*rows.columns).unionByName(changed, allowMissingColumns=True)


def lost_documents(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("doc_id").distinct().join(after.select("doc_id").distinct(), "doc_id", "left_anti")


def without_chunks(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that claim chunks but have none."""
    return manifest.where("chunk_count > 0").join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")


def available_documents(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    return manifest.where(F.coalesce("status", F.lit("done")) == "done").join(chunks.select("doc_id").distinct(), "doc_id", "left_semi")


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the documents of ``gone`` (``doc_id``): rows by ``doc_id``, and rows whose ``doc_ids`` name one of them, with all that hangs on their ``qid``."""
    ids = gone.select("doc_id").distinct()
    out = {n: t.join(ids, "doc_id", "left_anti") if "doc_id" in t.columns else t for n, t in tables.items()}
    asked = [t.select("qid", F.explode("doc_ids").alias("doc_id")).join(ids, "doc_id", "left_semi").select("qid") for t in out.values() if "doc_ids" in t.columns]
    if asked:
        qids = asked[0]
        for more in asked[1:]:
            qids = qids.unionByName(more)
        out = {n: t.join(qids.distinct(), "qid", "left_anti") if "qid" in t.columns else t for n, t in out.items()}
    return out


# Ids of questions that tests make, ids of the official question sets, and test runners' folders.
TEST_QIDS, OFFICIAL_QID, TEST_FOLDERS = ["q-", "test-", "debug-", "loop-"], r"^(?i)(fc|fin|ins|reg|res)_a_\d+$", ["/pytest-of-"]


def named_documents(evidence: Column, facts: Column | None = None) -> Column:
    """Ids that a row's evidence (structs with ``doc_id``) and its ledger's facts (structs with ``doc_ids``) name, each once, sorted."""
    none = F.array().cast("array<string>")
    of_facts = none if facts is None else F.flatten(F.coalesce(F.transform(facts, lambda f: F.coalesce(f["doc_ids"], none)), F.array(none)))
    named = F.concat(F.coalesce(F.transform(evidence, lambda e: e["doc_id"]), none), of_facts)
    return F.array_sort(F.array_distinct(F.filter(named, lambda d: F.coalesce(d, F.lit("")) != "")))


def delete_cascade(tables: dict[str, DataFrame], official: DataFrame) -> dict[str, DataFrame]:
    """``documents, chunks, results, tasks, evidence, answers`` without what test runs left; other tables stay as they are.

    Documents below a test runner's folder (``source_path``) go with their chunks and preprocessing tasks. Results and evidence rows go
    if they name one of them (``doc_ids``, see ``named_documents``), or if their question id looks like a test's and they name no document of
    ``official`` (``doc_id``); evidence also goes with a removed result's question id, unless that is official. Question tasks and answers follow the results. Nulls fit nothing.
    """
    gone = by_path_or_qid(tables["documents"], TEST_FOLDERS, [], path="source_path").where("doc_id is not null").select("doc_id").distinct()
    known = official.where("doc_id is not null").select("doc_id").distinct()
    qid = F.coalesce("qid", F.lit(""))
    is_official = qid.rlike(OFFICIAL_QID)
    is_test = F.exists(strings(TEST_QIDS), lambda p: F.startswith(F.lower(qid), p)) & ~is_official

    def judged(rows: DataFrame) -> DataFrame:
        """Adds ``drop``; rows with the same documents are judged once."""
        ids = rows.select("doc_ids").distinct()
        each = ids.select("doc_ids", F.explode("doc_ids").alias("doc_id"))
        hits = each.join(gone.withColumn("gone", F.lit(True)), "doc_id", "left").join(known.withColumn("known", F.lit(True)), "doc_id", "left")
        flags = hits.groupBy("doc_ids").agg(F.max(F.coalesce("gone", F.lit(False))).alias("gone"), F.max(F.coalesce("known", F.lit(False))).alias("known"))
        return rows.join(flags, "doc_ids", "left").withColumn("drop", F.coalesce("gone", F.lit(False)) | (is_test & ~F.coalesce("known", F.lit(False)))).drop("gone", "known")

    out = dict(tables)
    for name in ("documents", "chunks"):
        out[name] = tables[name].join(gone, "doc_id", "left_anti").select(*tables[name].columns)
    results = judged(tables["results"])
    removed = results.where("drop")
    tasks_gone = removed.where("task_id is not null").select("task_id").distinct()
    qids_gone = removed.where((qid != "") & ~is_official).select("qid").distinct()
    out["results"] = results.where("not drop").select(*tables["results"].columns)
    out["answers"] = tables["answers"].join(qids_gone, "qid", "left_anti").select(*tables["answers"].columns)
    out["evidence"] = judged(tables["evidence"]).where("not drop").join(qids_gone, "qid", "left_anti").select(*tables["evidence"].columns)
    asked, other = tables["tasks"].where("type = 'question'"), tables["tasks"].where("not (type <=> 'question')")
    asked = asked.join(tasks_gone, "task_id", "left_anti").join(qids_gone, "qid", "left_anti")
    ingested, rest = other.where("type = 'preprocess'"), other.where("not (type <=> 'preprocess')")
    out["tasks"] = rest.unionByName(ingested.join(gone, "doc_id", "left_anti")).unionByName(asked).select(*tables["tasks"].columns)
    return out


def by_path_or_qid(rows: DataFrame, path_parts: list[str], qid_prefixes: list[str], path: str = "path", qid: str = "qid") -> DataFrame:
    """Rows whose path (either kind of slash) holds one of ``path_parts``, or whose question id starts with one of ``qid_prefixes``; a missing column fits nothing."""
    none = F.lit(False)
    in_path = F.exists(strings(path_parts), lambda p: F.contains(F.lower(F.translate(path, "\\", "/")), F.lower(p))) if path in rows.columns else none
    in_qid = F.exists(strings(qid_prefixes), lambda p: F.startswith(qid, p)) if qid in rows.columns else none
    return rows.where(F.coalesce(in_path, none) | F.coalesce(in_qid, none))


def first_per_key(rows: DataFrame, keys: list, order: list) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")
