"""Registered queries of the training-data operators: each applies an operator to its whole table.

A query is thin: the operator gives texts, spans or ids, and the query derives the columns that are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.shared import spread

from . import audio, merkle, near_dedup, nearest, packing, quality_model, quality_rules, resampling, secret_scan, substring_dedup, token_counts, unigram, url_filter

#: Rules of the registered url query (fixed values).
URL_RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]
N_GRADES, GOOD = 3, 2


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on the driver; workers get its bytes by broadcast."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packing_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "seed_doc_id")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secret_scan.spans_text(secret_scan.sort_spans(F.concat("base", "decoded")))
    return found.select("doc_id", *map(count, secret_scan.KINDS), F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.describe_media(spread(table(spark, sf_dir, "documents"))).drop("segments")  # all of them stand in the feature


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spread(table(spark, sf_dir, "documents")), vocabulary("byte_bpe_50k.json"))


def op6_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = unigram.encode_pieces(spread(table(spark, sf_dir, "documents")), vocabulary("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_pieces", "n_byte_pieces", F.crc32("ids").alias("ids_crc32"), "round_trip")


def trained_grader(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_model.OrdinalModel:
    return quality_model.train(docs, quality_model.graded_ratings(table(spark, sf_dir, "labels")), N_GRADES)


def op7_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, trained_grader(spark, docs, sf_dir), GOOD)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & (F.col("toxic") == 0))
    return quality_rules.rate_quality(spread(table(spark, sf_dir, "documents")), trusted).drop("ratio")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(table(spark, sf_dir, "documents"), percent=85)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(F.filter(F.split("kept_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " "), 256).alias("kept_sha256"))


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and verification; where 5 divides the id's CRC-32, what is verified is a text with its letters lower-cased."""
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    lowered = columns | {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.digest([*lowered.values()]))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), merkle.digest([*columns.values()]), F.col("source"), [F.col("doc_id")], {"doc_id": F.col("doc_id").cast("long"), "tampered": tampered})
    rows = rows.withColumns({"proof_sha256": F.sha2(merkle.siblings(F.col("proof")), 256), "folded_root": merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, min_words=20, max_run=1, buckets=10_000, seed=2024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_packing, op2_secret_scan, op3_url_filter, op4_audio_features, op5_token_counts, op6_unigram_pieces, op7_quality_grades, op8_quality_rules, op9_near_duplicates, op10_repeated_passages, op11_nearest_vectors, op12_merkle_manifest, op13_target_resampling]
    return {f.__name__: f for f in own}


# -------------------------------------------------------------------------- SQL
_WORDS = r"list_filter(regexp_split_to_array({text}, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"

URL_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path,
         array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')), '&') AS query FROM u
), k AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM h
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT h.page_id, r.verdict, rhost || rpath AS rule, row_number() OVER (PARTITION BY h.page_id ORDER BY length(rhost || rpath) DESC) AS n
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), j AS (
  SELECT k.*, m.rule, m.verdict FROM k LEFT JOIN m ON m.page_id = k.page_id AND m.n = 1
), s AS (
  SELECT key FROM j WHERE key IS NOT NULL GROUP BY key HAVING bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN s.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN s ON s.key = j.key
"""

#: Near-duplicate groups by brute force over shingle sets.
NEAR_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS items, len(words) < 5 AS short FROM w
), n AS (SELECT doc_id, len(items) AS n_shingles, short FROM s),
x AS (SELECT doc_id, short, hash(unnest(items)) AS item FROM s),
k AS (SELECT item, short FROM x GROUP BY 1, 2 HAVING count(*) > 1),
y AS (SELECT x.* FROM x JOIN k USING (item, short)),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM y a JOIN y b ON a.item = b.item AND a.short = b.short AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= 85 * (a.n_shingles + b.n_shingles - common)
), d AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
c AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT d.v, c.root FROM c JOIN d ON d.u = c.node)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, min(c.root) AS component_id, n.doc_id = min(c.root) AS kept
FROM n JOIN c ON c.node = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""

PASSAGES_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
o AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
g AS (SELECT doc_id, i, array_to_string(words[i:i+34], ' ') AS text FROM o),
r AS (SELECT text FROM g GROUP BY 1 HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM g JOIN r USING (text)),
t AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept, count(*) AS n FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""


#: Nearest vectors by brute force.
NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.vec) + 1), lambda i: (q.vec[i] - c.vec[i]) * (q.vec[i] - c.vec[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM d)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""

#: CRC-32 of a list of byte values.
_CRC = "xor(list_reduce({bytes}, lambda a, b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295)"
_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}")) + ")"

MANIFEST_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {_LEAF.format(text="text")} AS leaf,
         CASE WHEN {_CRC.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 5 = 0
              THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d
), t(tree, level, place, h, n) AS (
  SELECT tree, 0, place, leaf, n FROM p
  UNION ALL SELECT tree, level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (max(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY tree, level, place // 16
), u(tree, level, place, h, n) AS (
  SELECT -1, 0, tree, h, count(*) OVER () FROM t WHERE n = 1
  UNION ALL SELECT -1, level + 1, place // 16, sha256(string_agg(h, '' ORDER BY place)), (max(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY level, place // 16
), nodes AS (SELECT * FROM t UNION ALL SELECT * FROM u),
s AS (
  SELECT a.tree, a.level, a.place, a.n, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.place // 16 = b.place // 16 GROUP BY a.tree, a.level, a.place, a.n
), w(row, tree, level, place, now, seen, open) AS (
  SELECT tree || '-' || place, tree, 0, place, coalesce(tampered, leaf), '', true FROM p
  UNION ALL
  SELECT row, CASE WHEN s.n > 1 THEN w.tree ELSE -1 END, CASE WHEN s.n > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN s.n > 1 THEN w.place // 16 ELSE w.tree END,
         CASE WHEN s.n > 1 THEN sha256(before || now || after) ELSE now END, CASE WHEN s.n > 1 THEN seen || before || after ELSE seen END, s.n > 1 OR w.tree >= 0
  FROM w JOIN s ON s.tree = w.tree AND s.level = w.level AND s.place = w.place WHERE w.open
), e AS (SELECT row, now, seen FROM w WHERE NOT open),
top AS (SELECT h AS root FROM u WHERE n = 1), sub AS (SELECT tree, h AS subroot FROM t WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(seen) AS proof_sha256, now AS folded_root, now = root AS verified FROM p JOIN sub USING (tree) JOIN e ON e.row = p.tree || '-' || p.place CROSS JOIN top
"""

RESAMPLING_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents),
g AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM benchmark),
f AS (SELECT row, unnest(words) AS word FROM d),
k AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM f UNION SELECT word FROM g)),
c AS (SELECT word, {_CRC.format(bytes="list_transform(range(1, len(x) + 1, 2), lambda i: 16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1)")} % 10000 AS bucket FROM k),
s AS (SELECT bucket, count(*) AS n FROM f JOIN c USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS n FROM g JOIN c USING (word) GROUP BY 1),
gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM s) + 10000.0::DOUBLE) / ((s.n + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000.0::DOUBLE)))) AS gain FROM s LEFT JOIN t USING (bucket)
), w AS (SELECT row, floor(sum(gain) / count(*)) AS weight FROM f JOIN c USING (word) JOIN gains USING (bucket) GROUP BY 1),
h AS (SELECT *, list_reduce(list_transform(string_split(substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS BIGINT)), lambda a, b: 16 * a + b) AS h FROM d),
o AS (SELECT doc_id, row, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h LEFT JOIN w USING (row)),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM o LEFT JOIN r USING (row)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express. The url query's joins urls by their keys only: the tables hold no redirects or canonical links."""
    return {"op3_url_filter": URL_SQL, "op9_near_duplicates": NEAR_SQL, "op10_repeated_passages": PASSAGES_SQL, "op11_nearest_vectors": NEAREST_SQL, "op12_merkle_manifest": MANIFEST_SQL, "op13_target_resampling": RESAMPLING_SQL}
