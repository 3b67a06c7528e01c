"""DuckDB SQL for the registered queries that it can express.

White space is ASCII on both sides here: the tables hold no other kind at line ends. Folds over produced
rows are ``list_reduce`` over a list of states; the diversified choice is a recursion over its steps. The main content of pages has no entry and is tested against plain Python.
"""

from __future__ import annotations

from docloom import profiles as P

_TEXT = "coalesce(text, '')"
_TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9.%]+'), lambda t: length(t) > 1)"
_LINES = (
    "list_filter(list_transform(regexp_split_to_array({0}, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), "
    "lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
)
_NOISE = "(x = '' OR regexp_matches(x, '(?i)^(第?\\s*\\d+\\s*页|page\\s*\\d+|\\d+/\\d+|\\d+)$') OR regexp_matches(x, '(?i)仅供参考|请仔细阅读|版权所有|联系电话[:：]?|网址[:：]?|www\\.|https?://'))"
_BM25 = "ln(1.0 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1.0 - 0.75 + 0.75 * length / greatest(mean, 1.0)))"


def _bm25_sql(fields: dict[str, float]) -> str:
    parts = []
    for field, weight in fields.items():
        parts.append(f"""
SELECT a.item_id, p.doc_id, {weight} * ({_BM25}) AS impact FROM asked a JOIN (
  SELECT doc_id, token, length, count(*) AS tf FROM (SELECT doc_id, len(toks) AS length, unnest(toks) AS token FROM (SELECT doc_id, {_TOKENS.format(f"coalesce({field}, '')")} AS toks FROM documents)) GROUP BY 1, 2, 3
) p USING (token) JOIN (
  SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS.format(f"coalesce({field}, '')")}) AS token FROM documents) GROUP BY 1
) d USING (token) CROSS JOIN (SELECT count(*) AS n_docs, avg(len({_TOKENS.format(f"coalesce({field}, '')")})) AS mean FROM documents) s""")
    return f"""
WITH asked AS (SELECT DISTINCT item_id, unnest({_TOKENS.format(_TEXT)}) AS token FROM benchmark), impacts AS ({" UNION ALL ".join(parts)}),
scored AS (SELECT item_id, doc_id, round(sum(impact), 4) AS score FROM impacts GROUP BY 1, 2)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 12"""


_STOP = "('" + "', '".join(P.STOP_WORDS) + "')"
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_PHRASES = _ONCE.format("list_filter(regexp_extract_all(question, '[\\x{4e00}-\\x{9fff}]{4,}|[A-Za-z0-9.%]{3,}'), lambda x: x NOT IN " + _STOP + ")") + "[1:16]"
_NUMBERS = _ONCE.format("regexp_extract_all(question, '\\d+(?:\\.\\d+)?%?')")
_HIGH = "list_filter(" + _ONCE.format(f"list_concat({_NUMBERS}, {_TOKENS.format('question')}, [question])") + f", lambda x: length(x) > 1 AND x NOT IN {_STOP})[1:24]"

#: Scores by words and rules of every pair of benchmark text and document, and which patterns a document holds.
_RULES = f"""
WITH q AS (SELECT item_id, question, {_PHRASES} AS phrases, {_HIGH} AS high, {_NUMBERS} AS numbers FROM (SELECT item_id, {_TEXT} AS question FROM benchmark)),
d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {_TEXT} AS text, regexp_replace(lower(coalesce(lang, '') || ' ' || {_TEXT}), '\\s+', '', 'g') AS form FROM documents),
f AS (SELECT item_id, phrases, high, numbers, list_transform(list_filter(phrases, lambda x: length(x) >= 4), lambda x: regexp_replace(lower(x), '\\s+', '', 'g')) AS pf,
             list_transform(high, lambda x: regexp_replace(lower(x), '\\s+', '', 'g')) AS hf, list_distinct(list_concat(phrases, high, numbers)) AS every FROM q),
c AS (SELECT item_id, doc_id, source, lang, len(numbers) AS n, len(list_filter(pf, lambda x: x <> '' AND contains(form, x))) AS p, len(list_filter(hf, lambda x: x <> '' AND contains(form, x))) AS h,
             len(list_filter(numbers, lambda x: contains(text, x) OR contains(lang, x))) AS m, length(trim(text)) AS size,
             list_filter(every, lambda x: regexp_replace(lower(x), '\\s+', '', 'g') <> '' AND contains(form, regexp_replace(lower(x), '\\s+', '', 'g'))) AS held FROM f CROSS JOIN d),
b AS (SELECT *, least(p, 2) * 2.5::DOUBLE + least(h, 6) * 0.7::DOUBLE + CASE WHEN h >= 2 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN m > 0 THEN 2.0::DOUBLE + 1.2::DOUBLE * m + CASE WHEN m = n THEN 2.0 ELSE 0 END ELSE 0 END
             + CASE WHEN doc_id % 10 = 0 AND n > 0 THEN 1.2::DOUBLE ELSE 0 END - CASE WHEN size < 20 THEN 1.5::DOUBLE ELSE 0 END AS boost FROM c)"""

RULE_SCORES = f"""{_RULES}
SELECT item_id, doc_id, round(boost, 4) AS boost FROM b QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(boost, 4) DESC, doc_id) <= 12"""

DOCUMENT_RANK = f"""{_RULES},
bm AS (SELECT item_id, doc_id, sum(weight * ({_BM25})) AS base FROM (SELECT DISTINCT item_id, unnest({_TOKENS.format(_TEXT)}) AS token FROM benchmark) a JOIN (
    SELECT field, weight, doc_id, token, length, count(*) AS tf FROM (SELECT field, weight, doc_id, len(toks) AS length, unnest(toks) AS token FROM (
      SELECT 'text' AS field, 1.0::DOUBLE AS weight, doc_id, {_TOKENS.format(_TEXT)} AS toks FROM documents UNION ALL SELECT 'lang', 3.0, doc_id, {_TOKENS.format("coalesce(lang, '')")} FROM documents)) GROUP BY ALL
  ) p USING (token) JOIN (SELECT field, token, count(DISTINCT doc_id) AS df FROM (SELECT 'text' AS field, doc_id, unnest({_TOKENS.format(_TEXT)}) AS token FROM documents UNION ALL SELECT 'lang', doc_id, unnest({_TOKENS.format("coalesce(lang, '')")}) FROM documents) GROUP BY 1, 2) x USING (field, token)
  JOIN (SELECT 'text' AS field, count(*) AS n_docs, avg(len({_TOKENS.format(_TEXT)})) AS mean FROM documents UNION ALL SELECT 'lang', count(*), avg(len({_TOKENS.format("coalesce(lang, '')")})) FROM documents) s USING (field) GROUP BY 1, 2),
r AS (SELECT b.*, coalesce(base, 0) + boost AS score FROM b LEFT JOIN bm USING (item_id, doc_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS nth FROM r),
g AS (SELECT item_id, source, sum(CASE WHEN nth = 1 THEN score WHEN nth <= 3 THEN 0.35::DOUBLE * score ELSE 0 END) + 0.3::DOUBLE * len(list_distinct(flatten(list(held)))) + 0.08::DOUBLE * count(DISTINCT lang) AS score, min(doc_id) AS first FROM t GROUP BY 1, 2)
SELECT item_id, source, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) AS rank FROM g) WHERE rank <= 8"""

_STRIP = "html"
for _tag in ("script", "style", "noscript", "form", "svg", "footer", "header", "nav", "aside"):
    # RE2 has no back-references: one pattern for each tag
    _STRIP = f"regexp_replace({_STRIP}, '(?is)<{_tag}.*?>.*?</{_tag}>', ' ', 'g')"
for _pattern, _by in (("(?is)<!--.*?-->", "' '"), ("(?is)<br\\s*/?>", "chr(10)"), ("(?is)</(p|div|li|tr|section|article|h\\d)>", "chr(10)"), ("(?is)<[^>]+>", "' '")):
    _STRIP = f"regexp_replace({_STRIP}, '{_pattern}', {_by}, 'g')"

_OPTIONS = "list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


_PARTS = "list_filter(list_transform(string_split(regexp_replace(array_to_string({0}, chr(10)), '([.!?;])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '')"
_OPENS = "regexp_matches({0}, '^(?:Section|Article|Chapter) [0-9]+')"

#: Parts of each document, joined while the last is shorter than 1000: a fold over the list, its state one list of texts.
_PACKED = f"""
parts AS (SELECT doc_id, {_PARTS.format(_LINES.format(_TEXT))} AS parts FROM documents),
packed AS (SELECT doc_id, list_reduce(list_prepend({{'p': []::VARCHAR[]}}, list_transform(parts, lambda x: {{'p': [x]}})), lambda a, b:
  CASE WHEN len(a.p) > 0 AND length(a.p[-1]) < 1000 AND NOT starts_with(b.p[1], '[table]') AND NOT {_OPENS.format("b.p[1]")} THEN {{'p': list_append(a.p[1:len(a.p) - 1], a.p[-1] || ' ' || b.p[1])}}
  ELSE {{'p': list_concat(a.p, b.p)}} END).p AS packed FROM parts)"""

#: Parts over 1200 as sentences, packed up to 1000; a single one is cut to 1200.
_BLOCKS = f"""{_PACKED},
each_part AS (SELECT doc_id, unnest(packed) AS part, unnest(range(len(packed))) AS place FROM packed),
folded AS (SELECT doc_id, place, part, list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': ''}}, list_transform(list_filter(string_split(regexp_replace(part, '([.!?;])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10)) <> ''), lambda x: {{'done': []::VARCHAR[], 'open': x}})), lambda a, b:
  CASE WHEN length(a.open) + length(b.open) <= 1000 THEN {{'done': a.done, 'open': a.open || b.open}}
  ELSE {{'done': CASE WHEN a.open <> '' THEN list_append(a.done, a.open) ELSE a.done END, 'open': substr(b.open, 1, 1200)}} END) AS f FROM each_part WHERE length(part) > 1200),
blocks AS (SELECT doc_id, place, 0 AS sub, part AS block FROM each_part WHERE length(part) <= 1200
  UNION ALL SELECT doc_id, place, unnest(range(len(all_))) AS sub, unnest(all_) FROM (SELECT doc_id, place, CASE WHEN f.open <> '' THEN list_append(f.done, f.open) ELSE f.done END AS all_ FROM folded)),
numbered AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY place, sub) - 1 AS n FROM blocks)"""

#: Evidence scores of every option (``i`` counts an item's sentences) against the item's best documents.
_SCORES = f"""
top AS ({_bm25_sql({"text": 1.0})}),
o AS (SELECT item_id, question, unnest(options) AS option_text, unnest(range(len(options))) AS i FROM (SELECT item_id, {_TEXT} AS question, {_OPTIONS.format(_TEXT)} AS options FROM benchmark)),
ot AS (SELECT item_id, i, token, count(*) AS tf FROM (SELECT item_id, i, unnest({_TOKENS.format("option_text")}) AS token FROM o) GROUP BY ALL),
qt AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({_TOKENS.format(_TEXT)}) AS token FROM benchmark) GROUP BY ALL),
dt AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format(_TEXT)}) AS token FROM documents SEMI JOIN top USING (doc_id)) GROUP BY ALL),
onorm AS (SELECT item_id, i, sqrt(CAST(sum(tf * tf) AS DOUBLE)) + 1 AS n FROM ot GROUP BY ALL), qnorm AS (SELECT item_id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) + 1 AS n FROM qt GROUP BY ALL),
oc AS (SELECT ot.item_id, ot.i, top.doc_id, sum(least(ot.tf, dt.tf)) AS c FROM ot JOIN top USING (item_id) JOIN dt ON dt.doc_id = top.doc_id AND dt.token = ot.token GROUP BY ALL),
qc AS (SELECT qt.item_id, top.doc_id, sum(least(qt.tf, dt.tf)) AS c FROM qt JOIN top USING (item_id) JOIN dt ON dt.doc_id = top.doc_id AND dt.token = qt.token GROUP BY ALL),
nums AS (SELECT o.item_id, o.i, top.doc_id, len(list_intersect(list_distinct(regexp_extract_all(o.option_text, '\\d+(?:\\.\\d+)?')), regexp_extract_all(coalesce(d.text, ''), '\\d+(?:\\.\\d+)?'))) AS k FROM o JOIN top USING (item_id) JOIN documents d ON d.doc_id = top.doc_id),
s AS (SELECT o.item_id, o.i, top.doc_id, top.rank, coalesce(oc.c / onorm.n, 0) + 0.3::DOUBLE * coalesce(qc.c / qnorm.n, 0) + least(0.15::DOUBLE * nums.k, 0.3::DOUBLE) AS score
  FROM o JOIN top USING (item_id) JOIN nums ON nums.item_id = o.item_id AND nums.i = o.i AND nums.doc_id = top.doc_id LEFT JOIN oc ON oc.item_id = o.item_id AND oc.i = o.i AND oc.doc_id = top.doc_id
  LEFT JOIN onorm ON onorm.item_id = o.item_id AND onorm.i = o.i LEFT JOIN qc ON qc.item_id = o.item_id AND qc.doc_id = top.doc_id LEFT JOIN qnorm ON qnorm.item_id = o.item_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, i ORDER BY score DESC, rank) AS n FROM s) WHERE n <= 3)"""
_QID = "item_id || '-' || (i // 6) AS qid, ['A', 'B', 'C', 'D', 'E', 'F'][i % 6 + 1] AS option"

#: Latin texts hold none of the negations and calculation words, so an option is supported or its evidence insufficient.
_VERDICTS = f"""{_SCORES},
held AS (SELECT best.item_id, best.i, max(score) FILTER (WHERE n = 1) AS top1, sum(score) / count(*) AS average, string_agg(coalesce(d.text, ''), ' ' ORDER BY n) AS top_text FROM best JOIN documents d USING (doc_id) GROUP BY 1, 2),
facts AS (SELECT o.item_id, o.i, coalesce(top1, 0) AS top1, coalesce(average, 0) AS average, coalesce(top_text, '') AS top_text, list_distinct(regexp_extract_all(option_text, '\\d+(?:\\.\\d+)?\\s*%|\\d+(?:\\.\\d+)?')) AS markers,
  list_distinct({_TOKENS.format("option_text")}) AS tokens, len(list_intersect(regexp_extract_all(option_text, '\\d+(?:\\.\\d+)?'), regexp_extract_all(coalesce(top_text, ''), '\\d+(?:\\.\\d+)?'))) AS matched
  FROM o LEFT JOIN held ON held.item_id = o.item_id AND held.i = o.i),
judged AS (SELECT *, CASE WHEN len(markers) > 0 THEN len(list_filter(markers, lambda m: contains(regexp_replace(top_text, '\\s+', '', 'g'), regexp_replace(m, '\\s+', '', 'g')))) > 0 WHEN len(tokens) = 0 THEN true
  ELSE len(list_filter(tokens, lambda w: contains(top_text, w))) / len(tokens) >= 0.3::DOUBLE END AS substance FROM facts),
first_ AS (SELECT *, CASE WHEN top1 < 0.1::DOUBLE OR average < 0.2::DOUBLE OR NOT substance THEN 'insufficient' ELSE 'support' END AS v, CASE WHEN top1 < 0.1::DOUBLE THEN 0.1::DOUBLE WHEN average < 0.2::DOUBLE THEN 0.2::DOUBLE WHEN NOT substance THEN 0.25::DOUBLE
  WHEN matched > 0 THEN round(least(least(0.4::DOUBLE + average * 0.6::DOUBLE, 0.9::DOUBLE) + 0.1::DOUBLE, 0.95::DOUBLE), 2) ELSE round(least(0.4::DOUBLE + average * 0.6::DOUBLE, 0.9::DOUBLE), 2) END AS c,
  median(CASE WHEN top1 > 0 THEN top1 END) OVER g AS middle, count(CASE WHEN top1 > 0 THEN 1 END) OVER g AS positive FROM judged WINDOW g AS (PARTITION BY item_id, i // 6)),
final AS (SELECT *, v <> 'insufficient' AND positive >= 3 AND middle > 0.1::DOUBLE AND top1 < 0.35::DOUBLE * middle AS weak FROM first_),
verdicts AS (SELECT {_QID}, CASE WHEN weak THEN 'insufficient' ELSE v END AS verdict, CASE WHEN weak THEN 0.25::DOUBLE ELSE c END AS confidence, round(top1, 6) AS top1_score FROM final)"""

_META = "coalesce(nullif(regexp_extract(html, '(?is)<meta[^>]+name=[\"'']{0}[\"''][^>]+content=[\"''](.*?)[\"'']', 1), ''), nullif(regexp_extract(html, '(?is)<meta[^>]+content=[\"''](.*?)[\"''][^>]+name=[\"'']{0}[\"'']', 1), ''))"


def oracle_sql() -> dict[str, str]:
    lines = _LINES.format(_TEXT)
    return {
        "bm25_topk": _bm25_sql({"text": 1.0}),
        "bm25_multi_field": _bm25_sql({"source": 4.0, "lang": 3.0, "text": 1.0}),
        "token_freq": f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS.format(_TEXT)}) AS token FROM documents) GROUP BY 1",
        "doc_stats": f"SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS mean_length FROM (SELECT len({_TOKENS.format(_TEXT)}) AS n FROM documents)",
        "overlap_score": f"""
WITH q AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({_TOKENS.format(_TEXT)}) AS token FROM benchmark) GROUP BY 1, 2),
d AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format(_TEXT)}) AS token FROM documents) GROUP BY 1, 2),
n AS (SELECT item_id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) + 1.0 AS norm FROM q GROUP BY 1),
s AS (SELECT q.item_id, d.doc_id, round(sum(least(q.tf, d.tf)) / any_value(norm), 6) AS score FROM q JOIN d USING (token) JOIN n ON n.item_id = q.item_id GROUP BY 1, 2)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 5""",
        "rule_scores": RULE_SCORES,
        "document_rank": DOCUMENT_RANK,
        "doc_rank": """
WITH t AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents)
SELECT source, round(sum(CASE WHEN r = 1 THEN CAST(n_chars AS DOUBLE) ELSE n_chars * 0.35::DOUBLE END), 4) AS score FROM t WHERE r <= 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""",
        "signal_boost": f"""
WITH t AS (SELECT doc_id, {_TEXT} AS text, len(list_distinct(regexp_extract_all({_TEXT}, '\\d+(?:\\.\\d+)?%?'))) AS found FROM documents)
SELECT doc_id, round(CASE WHEN found > 0 THEN 2.0::DOUBLE + 1.2::DOUBLE * found ELSE 0.0::DOUBLE END - CASE WHEN length(trim(text)) < 20 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END, 4) AS boost FROM t""",
        "page_title": "SELECT page_id, regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1) AS title FROM pages",
        "html_strip": f"""
WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(replace({_STRIP}, chr(0), ' '), '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' \t' || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
SELECT page_id, md5(regexp_replace(text, '\\s+', ' ', 'g')) AS text_md5, length(regexp_replace(text, '\\s+', '', 'g')) AS n_chars FROM t""",
        "lines_clean": f"""
WITH t AS (SELECT doc_id, list_filter({lines}, lambda x: NOT {_NOISE}) AS kept FROM documents),
e AS (SELECT doc_id, unnest(kept) AS line, unnest(range(len(kept))) AS i FROM t),
l AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM e),
j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l WHERE before IS NULL OR before <> line GROUP BY 1)
SELECT t.doc_id, CAST(len(kept) AS BIGINT) AS n_lines, md5(coalesce(j.text, '')) AS text_md5 FROM t LEFT JOIN j ON j.doc_id = t.doc_id""",
        "edge_lines": f"""
WITH t AS (SELECT source, {lines} AS l FROM documents), n AS (SELECT source, CASE WHEN count(*) <= 3 THEN 2 ELSE 3 END AS least FROM documents GROUP BY 1),
e AS (SELECT source, 'header' AS edge, l[1] AS x FROM t WHERE len(l) > 0 UNION ALL SELECT source, 'footer', l[-1] FROM t WHERE len(l) > 0)
SELECT source, edge, x AS line FROM e JOIN n USING (source)
WHERE CASE WHEN edge = 'header' THEN length(x) BETWEEN 3 AND 80 AND NOT regexp_matches(x, '(?i)^(第?\\s*\\d+\\s*页|page\\s*\\d+|\\d+/\\d+|\\d+)$') ELSE length(x) BETWEEN 1 AND 80 END
GROUP BY 1, 2, 3 HAVING count(*) >= any_value(least)""",
        "segment_sentences": f"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(array_to_string({lines}, chr(10)), '([.!?;])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_parts, CAST(coalesce(list_max(list_transform(parts, lambda x: length(x))), 0) AS BIGINT) AS longest FROM t""",
        "pack_fragments": f"WITH {_PACKED} SELECT doc_id, CAST(n AS INTEGER) AS n, length(part) AS length, md5(part) AS part_md5 FROM (SELECT doc_id, unnest(packed) AS part, unnest(range(len(packed))) AS n FROM packed)",
        "split_oversized": f"WITH {_BLOCKS} SELECT doc_id, CAST(n AS INTEGER) AS n, length(block) AS length FROM numbered",
        "chunk_documents": f"""
WITH {_BLOCKS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(substr(block, 1, 160), '\\s+', '', 'g') ORDER BY n) AS first FROM numbered)
SELECT doc_id || '-chunk-' || row_number() OVER (PARTITION BY doc_id ORDER BY n) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id,
  CASE WHEN starts_with(block, '[table]') THEN 'table' WHEN regexp_matches(block, '^\\s*(?:Section|Article) [0-9]+') THEN 'clause' ELSE 'prose' END AS chunk_type, length(block) AS length FROM firsts WHERE first = 1""",
        "evidence_top3": f"WITH {_SCORES} SELECT {_QID}, n, CAST(doc_id AS VARCHAR) AS doc_id, round(score, 4) AS score FROM best",
        "verdicts": f"WITH {_VERDICTS} SELECT qid, option, verdict, confidence, top1_score FROM verdicts",
        "rule_answers": f"""
WITH {_VERDICTS}, a AS (SELECT qid, string_agg(option, '' ORDER BY option) FILTER (WHERE verdict = 'support') AS yes, string_agg(option, '' ORDER BY option) FILTER (WHERE verdict = 'insufficient') AS open FROM verdicts GROUP BY 1)
SELECT qid, coalesce(yes, open, 'A') AS answer FROM a""",
        "html_meta": f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
SELECT page_id, coalesce({_META.format("ArticleTitle")}, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \\t]+', ' ', 'g'))) AS title,
  coalesce({_META.format("PubDate")}, nullif(regexp_extract(html, '(?is)<th>\\s*发文日期\\s*</th>\\s*<td[^>]*>(.*?)</td>', 1), ''), '') AS pub_date,
  coalesce({_META.format("ContentSource")}, {_META.format("SiteName")}, nullif(regexp_extract(html, '(?is)<th>\\s*发布机构\\s*</th>\\s*<td[^>]*>(.*?)</td>', 1), ''), nullif(regexp_extract(html, '(?i)主办单位[:：]\\s*([^<\\n]+)', 1), ''), '') AS source FROM t""",
        "merge_adjacent": f"""
WITH t AS (SELECT conv_id, list({{'done': []::STRUCT(l BIGINT, n BIGINT)[], 'l': length({_TEXT}), 'n': 0::BIGINT, 'opens': {_OPENS.format(f"trim({_TEXT})")}}} ORDER BY turn, {_TEXT}) AS items FROM conversations GROUP BY 1),
f AS (SELECT conv_id, list_reduce(items, lambda a, b: CASE WHEN NOT b.opens AND a.l + b.l <= 1200 AND (a.l < 200 OR b.l < 200) THEN {{'done': a.done, 'l': least(a.l + b.l + 1, 1200), 'n': a.n + 1, 'opens': a.opens}}
  ELSE {{'done': list_append(a.done, {{'l': a.l, 'n': a.n}}), 'l': b.l, 'n': 0::BIGINT, 'opens': b.opens}} END) AS r FROM t),
d AS (SELECT conv_id, list_append(r.done, {{'l': r.l, 'n': r.n}}) AS chunks FROM f)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, chunk_ord, c.l AS length, c.n AS n_merged FROM (SELECT conv_id, unnest(chunks) AS c, unnest(range(len(chunks))) AS chunk_ord FROM d)""",
        "diversified_top12": """
WITH RECURSIVE r AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, lang, source, n_chars / 1000::DOUBLE AS now, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS n, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents
), s AS (
  SELECT 0 AS step, chunk_id, lang, source, now, place, FALSE AS picked FROM r WHERE n <= 12
  UNION ALL
  SELECT step + 1, chunk_id, lang, source, CASE WHEN place = best THEN '-inf'::DOUBLE ELSE now - CASE WHEN lang = l THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN lang = l AND source = c THEN 1.25::DOUBLE ELSE 0 END END, place, place = best
  FROM (SELECT *, first_value(place) OVER w AS best, first_value(lang) OVER w AS l, first_value(source) OVER w AS c FROM s WINDOW w AS (ORDER BY now DESC, place)) WHERE step < 12
)
SELECT 'all' AS qid, chunk_id, step AS rank FROM s WHERE picked""",
        "stratified_sample": """
SELECT stratum, doc_id FROM (SELECT lang AS stratum, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('20260625-' || doc_id), doc_id) AS n FROM documents)
WHERE n <= CASE stratum WHEN 'en' THEN 20 WHEN 'fr' THEN 10 WHEN 'de' THEN 10 WHEN 'es' THEN 10 ELSE 0 END""",
        "dedup_exact": f"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY regexp_replace({_TEXT}, '\\s+', '', 'g')",
        "dedup_prefix160": f"""
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, regexp_replace(substr({_TEXT}, 1, 160), '\\s+', '', 'g') ORDER BY doc_id) AS n FROM documents) WHERE n = 1""",
        "dedup_latest": "SELECT conv_id, arg_max(role, turn) AS role, CAST(arg_max(length(coalesce(text, '')), turn) AS BIGINT) AS n, min(turn) AS first_turn FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1",
        "dup_report": f"SELECT 'global' AS scope, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM documents GROUP BY regexp_replace({_TEXT}, '\\s+', '', 'g')) WHERE n > 1 HAVING count(*) > 0",
        "chunk_quality": f"""
WITH t AS (SELECT {_TEXT} AS t, length({_TEXT}) AS n, source, doc_id % 10 = 0 AS clause FROM documents)
SELECT count(*) AS total_chunks, min(n) AS min_length, median(n) AS median_length, round(avg(n), 1) AS mean_length, max(n) AS max_length,
count(*) FILTER (WHERE n < 200) AS lt_200, count(*) FILTER (WHERE n BETWEEN 200 AND 499) AS range_200_500, count(*) FILTER (WHERE n BETWEEN 500 AND 799) AS range_500_800, count(*) FILTER (WHERE n >= 800) AS gte_800,
round(100.0::DOUBLE * count(*) FILTER (WHERE n < 200) / count(*), 1) AS lt_200_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE n BETWEEN 200 AND 499) / count(*), 1) AS range_200_500_pct,
round(100.0::DOUBLE * count(*) FILTER (WHERE n BETWEEN 500 AND 799) / count(*), 1) AS range_500_800_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE n >= 800) / count(*), 1) AS gte_800_pct,
count(*) FILTER (WHERE clause) AS with_clause, round(100.0::DOUBLE * count(*) FILTER (WHERE clause) / count(*), 1) AS clause_pct, count(*) FILTER (WHERE contains(t, chr(65533))) AS garbled_chars,
count(*) FILTER (WHERE regexp_matches(t, '[^\\x{{4e00}}-\\x{{9fff}}\\x{{3000}}-\\x{{303f}}\\x{{ff00}}-\\x{{ffef}}\\s]{{50,}}')) AS long_non_cjk, count(*) FILTER (WHERE length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) = 0) AS empty_text,
count(*) FILTER (WHERE trim(coalesce(source, '')) = '') AS no_section_path, count(*) FILTER (WHERE length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) < 20) AS excessively_short FROM t""",
        "length_buckets": f"SELECT CASE WHEN n < 200 THEN 'lt_200' WHEN n < 500 THEN 'range_200_500' WHEN n < 800 THEN 'range_500_800' ELSE 'gte_800' END AS bucket, count(*) AS n FROM (SELECT length({_TEXT}) AS n FROM documents) GROUP BY 1",
        "sensitive_scan": f"SELECT doc_id, regexp_matches({_TEXT}, '\\b1[3-9]\\d{{9}}\\b|\\b\\d{{17}}[\\dXx]\\b|\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b') AS sensitive FROM documents",
        "annotate_numbers": f"""
WITH t AS (SELECT doc_id, {_TEXT} AS text, list_filter([CASE WHEN regexp_matches({_TEXT}, '\\d+(?:\\.\\d+)?\\s*%') THEN '[公式] 百分比' END, CASE WHEN regexp_matches({_TEXT}, '\\d+(?:\\.\\d+)?\\s*[÷/]\\s*\\d+(?:\\.\\d+)?') THEN '[公式] 除法' END], lambda x: x IS NOT NULL) AS tags FROM documents)
SELECT doc_id, md5(CASE WHEN len(tags) > 0 AND NOT starts_with(text, '[公式]') THEN array_to_string(tags, ' ') || ' ' || substr(text, 1, 1200 - length(array_to_string(tags, ' ')) - 1) ELSE text END) AS text_md5 FROM t""",
        "question_plan": f"""
SELECT item_id || '-' || unnest(range((n + 5) // 6)) AS qid, 'general' AS domain, 'multi_select' AS question_type, false AS requires_multi_doc, 1 AS min_doc_coverage, numbers
FROM (SELECT item_id, len({_OPTIONS.format(_TEXT)}) AS n, array_to_string(regexp_extract_all({_TEXT}, '\\d+(?:\\.\\d+)?%?'), ',') AS numbers FROM benchmark) WHERE n > 0""",
        "evidence_pack": f"""
WITH top AS ({_bm25_sql({"text": 1.0})}),
l AS (SELECT item_id, rank, rank || '. [doc=' || doc_id || ', page=1] ' || substr(trim(regexp_replace(coalesce(d.text, ''), '\\s+', ' ', 'g')), 1, 1200) AS line FROM top JOIN documents d USING (doc_id)),
w AS (SELECT *, sum(length(line)) OVER (PARTITION BY item_id ORDER BY rank) AS running, count(*) OVER (PARTITION BY item_id) * 5 AS quota FROM l),
t AS (SELECT item_id, string_agg(line, chr(10) ORDER BY rank) AS text FROM w WHERE rank <= quota OR running <= 24000 GROUP BY 1)
SELECT CAST(item_id AS VARCHAR) AS qid, md5(text) AS text_md5, length(text) AS length FROM t""",
        "summary_row": """
WITH t AS (SELECT concat_ws('-', conv_id, turn) AS qid, substr(role, 1, 1) AS r, length(coalesce(text, '')) AS p, turn AS c, length(role) AS t FROM conversations),
a AS (SELECT qid, coalesce(nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(upper(coalesce(r, '')), '[A-F]'))), ''), ''), 'A') AS answer, p, c, t FROM t)
SELECT 'summary' AS qid, '' AS answer, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(t) AS BIGINT) AS total_tokens FROM a
UNION ALL SELECT qid, answer, p, c, t FROM a""",
        "p95_nearest_rank": """
WITH t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS m FROM events WHERE value IS NOT NULL)
SELECT event_type, value FROM t WHERE n = greatest(CAST(floor(m * 0.95::DOUBLE) AS BIGINT), 1)""",
        "status_pivot": """
SELECT coalesce(source, 'unknown') AS source, count(*) AS total, count(*) FILTER (WHERE toxic IS DISTINCT FROM 1 AND quality IS DISTINCT FROM 0) AS pass, count(*) FILTER (WHERE toxic IS DISTINCT FROM 1 AND quality = 0) AS warn,
count(*) FILTER (WHERE toxic = 1) AS fail, round(count(*) FILTER (WHERE toxic IS DISTINCT FROM 1 AND quality IS DISTINCT FROM 0) / count(*), 4) AS pass_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
        "issue_topk": "SELECT event_type, n FROM (SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1 ORDER BY n DESC, first LIMIT 12)",
        "gold_accuracy": f"""
SELECT count(*) AS compared, count(*) FILTER (WHERE g = a) AS correct, round(count(*) FILTER (WHERE g = a) / count(*), 4) AS accuracy
FROM (SELECT CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS g, CASE WHEN regexp_matches({_TEXT}, '[#*$%&|]{{3}}') THEN 'B' ELSE 'A' END AS a FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)""",
        "availability_semi": "SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)",
        "missing_anti": "SELECT DISTINCT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
        "union_overlay": "SELECT doc_id, 'local' AS source FROM labels UNION ALL SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
        "usage_by_domain": """
SELECT role AS domain, count(*) AS cases, count(*) FILTER (WHERE n + turn > 0) AS llm_success, CAST(sum(n) AS BIGINT) AS prompt_tokens, CAST(sum(turn) AS BIGINT) AS completion_tokens, CAST(sum(n + turn) AS BIGINT) AS total_tokens,
round(avg(CAST(turn AS DOUBLE)), 2) AS avg_duration_ms, round(avg(n + turn), 2) AS avg_total_tokens FROM (SELECT role, turn, length(coalesce(text, '')) AS n FROM conversations) GROUP BY 1""",
        "facet_summary": """
WITH t AS (SELECT unnest([{'f': 'file_type', 'v': lang}, {'f': 'category', 'v': source}, {'f': 'status', 'v': CASE WHEN n_chars > 1000 THEN 'done' ELSE 'failed' END}, {'f': 'all', 'v': 'all'}]) AS x, n_chars FROM documents)
SELECT x.f AS facet, x.v AS value, count(*) AS documents, round(avg(CAST(n_chars AS DOUBLE)), 4) AS avg_seconds, round(avg(n_chars), 4) AS avg_chunks FROM t GROUP BY 1, 2""",
    }
