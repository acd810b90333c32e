"""More registered queries: text functions, parsers, splitters, evaluation and the store. Registered by plans/catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunk as chunking
from tessella.operators import evaluate, parse, versions
from tessella.plans.catalog import SQL_ADAPTIVE, SQL_COMPARABLE, SQL_LINES, SQL_NOISE, SQL_PAIRS, SQL_SIGNIFICANT, SQL_TRIM, documents, line_chunks, order_versions, pairs, query, questions, sql_distinct, sql_terms, table
from tessella.sources import files

# ---- text functions ------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, list_sort({SQL_ADAPTIVE.format(x='text')}) AS terms FROM documents")
def adaptive_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(T.adaptive_terms(F.col("text"))).alias("terms"))


SQL_RERANK_TERMS = sql_terms("text", T.RERANK_STOP_WORDS, "length(w) >= 2")


@query(f"WITH t AS (SELECT doc_id, {SQL_RERANK_TERMS} AS t FROM documents) SELECT doc_id, {sql_distinct('t')} AS terms FROM t")
def rerank_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.rerank_terms(F.col("text")).alias("terms"))


# claims: marks stand for the places to split at. A second pass finds ends that the first one's matches overlap.
SQL_CLAIMS = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({x}, " + SQL_TRIM + "), '(^|[^0-9])([.!?;])\\s+', '\\1\\2\x01', 'g'), '(^|[^0-9])([.!?;])\\s+', '\\1\\2\x01', 'g'), '[\\n\\r]+', '\x01', 'g'), '\\s+and\\s+((?:is|was|has|does|represents|created|accepts)\\b)', '\x01\\1', 'g'), '\x01'), lambda c: trim(c, " + SQL_TRIM + ")), lambda c: c <> '')"
SQL_NEGATED = "regexp_matches({x}, '\\b(?:is not|was not|has no|does not have|never|without)\\b')"


@query(f"WITH {SQL_PAIRS}, c AS (SELECT conv_id, turn, {SQL_CLAIMS.format(x='answer')} AS cs FROM pairs) SELECT conv_id, turn, CAST(unnest(range(len(cs))) AS INTEGER) AS claim_no, unnest(cs) AS claim FROM c")
def claims_split(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.posexplode(T.claims(F.col("answer"), "en")).alias("claim_no", "claim"))


SQL_CLAIM_ROWS = f"c0 AS (SELECT conv_id, turn, question, {SQL_CLAIMS.format(x='answer')} AS cs FROM pairs), c AS (SELECT conv_id, turn, question, unnest(range(len(cs))) AS n, unnest(cs) AS claim FROM c0)"
SQL_PROTECTED = "list_distinct(list_transform(list_filter(regexp_extract_all(claim, 'O\\([^\\)]+\\)|\\b\\d+(?:[.,]\\d+)?\\b|\\b[A-Z][A-Za-z0-9_-]{1,}(?:\\[[^\\]]+\\])?|\\b[A-Za-z]\\[[^\\]]+\\]'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in T.PROTECTED_IGNORED) + ")), lambda t: " + SQL_COMPARABLE.format(x="t") + "))"


@query(f"WITH {SQL_PAIRS}, {SQL_CLAIM_ROWS} SELECT conv_id, turn, CAST(n AS INTEGER) AS claim_no, {SQL_NEGATED.format(x='claim')} AS negated FROM c")
def claims_negated(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("conv_id", "turn", F.posexplode(T.claims(F.col("answer"), "en")).alias("claim_no", "claim"))
    return rows.select("conv_id", "turn", "claim_no", T.is_negated(F.col("claim"), "en").alias("negated"))


# ---- evaluation ----------------------------------------------------------------------------------------------------


def _answers(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("case_id", F.concat_ws(":", "conv_id", "turn"))
    return rows, rows.select("case_id", F.lit(1).alias("source_rank"), F.col("question").alias("chunk_id"), F.col("question").alias("content"))


@query(
    f"""WITH {SQL_PAIRS}, {SQL_CLAIM_ROWS},
t AS (SELECT *, {SQL_COMPARABLE.format(x='claim')} AS cc, {SQL_COMPARABLE.format(x='question')} AS src, {sql_distinct(sql_terms('claim', T.SIGNIFICANT_STOP_WORDS, SQL_SIGNIFICANT))} AS terms, {SQL_PROTECTED} AS fixed FROM c),
g AS (SELECT conv_id, turn, {SQL_NEGATED.format(x='cc')} = {SQL_NEGATED.format(x='src')} AND (contains(src, cc) OR (len(list_filter(fixed, lambda w: NOT contains(src, w))) = 0 AND len(terms) > 0 AND len(list_filter(terms, lambda w: contains(src, w))) >= 0.6 * len(terms))) AS good FROM t),
v AS (SELECT conv_id, turn, avg(CAST(good AS INTEGER)) AS v FROM g GROUP BY ALL)
SELECT conv_id || ':' || turn AS case_id, 'groundedness' AS metric, coalesce(v, 0.0) AS value, coalesce(v, 0.0) >= 0.8 AS passed FROM pairs LEFT JOIN v USING (conv_id, turn)"""
)
def groundedness(spark, sf_dir):
    rows, sources = _answers(spark, sf_dir)
    return evaluate.groundedness(rows.select("case_id", "answer"), sources, language="en")


SQL_EVIDENCE = f"""e AS (SELECT item_id AS case_id, doc_id, list_distinct(list_filter(regexp_split_to_array(b.text, '[ \n]+'), lambda w: w <> '')) AS ws, d.text AS content FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"""


@query(
    f"""WITH {SQL_EVIDENCE}, m AS (SELECT case_id, len(list_filter(ws, lambda w: NOT contains(cmp, {SQL_COMPARABLE.format(x='w')}) AND NOT contains(cmp, 'the'))) = 0 AS met FROM (SELECT *, {SQL_COMPARABLE.format(x='content')} AS cmp FROM e))
SELECT case_id, 'evidence_recall' AS metric, avg(CAST(met AS INTEGER)) AS value, avg(CAST(met AS INTEGER)) = 1 AS passed FROM m GROUP BY case_id"""
)
def evidence_recall(spark, sf_dir):
    """Evidence of question i is document i: each word of the question, or `the` in its place."""
    words = F.array_distinct(F.filter(F.split("content", "[ \n]+"), lambda w: w != ""))
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    asked = questions(spark, sf_dir).join(ids.select(F.col("document_id").alias("question_id")), "question_id", "left_semi")
    evidence = asked.select(F.col("question_id").alias("case_id"), F.lit(0).alias("evidence_no"), F.col("question_id").alias("document_id"), F.transform(words, lambda w: F.array(w, F.lit("the"))).alias("groups"))
    return evaluate.evidence_recall(evidence, ids.select(F.col("document_id").alias("case_id"), "document_id", "content"))


SQL_CASES = "cases AS (SELECT DISTINCT doc_id AS case_id, quality = 0 AS none FROM labels)"


@query(f"WITH {SQL_CASES}, got AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT case_id, 'no_evidence' AS metric, CASE WHEN doc_id IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS value, doc_id IS NULL AS passed FROM cases LEFT JOIN got ON doc_id = case_id WHERE none")
def no_evidence_metric(spark, sf_dir):
    """Cases of low quality expect nothing; toxic ones got something."""
    rows = table(spark, sf_dir, "labels")
    cases = rows.select(F.col("doc_id").alias("case_id"), (F.col("quality") == 0).alias("expect_no_evidence")).distinct()
    return evaluate.no_evidence_metric(cases, rows.where("toxic = 1").select(F.col("doc_id").alias("case_id")))


SQL_SCORES = """s AS (SELECT doc_id AS case_id, 'groundedness' AS metric, quality * 0.9 AS value, quality = 1 AS passed FROM labels UNION ALL SELECT doc_id, 'chunk_hit_at_1', 0.0, FALSE FROM labels
  UNION ALL SELECT doc_id, 'chunk_recall', 1.0, toxic = 0 FROM labels)"""


@query(
    f"""WITH {SQL_SCORES}, p AS (SELECT case_id, min(CASE WHEN metric = 'groundedness' THEN value >= 0.8 ELSE passed END) AS ok FROM s WHERE NOT ends_with(metric, '_hit_at_1') GROUP BY case_id)
SELECT doc_id AS case_id, CASE WHEN doc_id % 50 = 7 THEN 'error' WHEN ok IS NULL THEN 'not_applicable' WHEN ok THEN 'passed' ELSE 'failed' END AS status FROM documents LEFT JOIN p ON case_id = doc_id"""
)
def case_status(spark, sf_dir):
    rows, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"))
    score = lambda name, value, passed: rows.select(F.col("doc_id").alias("case_id"), F.lit(name).alias("metric"), value.cast("double").alias("value"), passed.alias("passed"))
    good = F.col("quality") == 1
    scores = score("groundedness", F.col("quality") * 0.9, good).union(score("chunk_hit_at_1", F.lit(0.0), F.lit(False))).union(score("chunk_recall", F.lit(1.0), F.col("toxic") == 0))
    return evaluate.case_status(docs, scores, docs.where("case_id % 50 = 7"))


# ---- parsers -------------------------------------------------------------------------------------------------------


def _blocks(rows, key):
    return rows.select(key, F.posexplode("blocks").alias("block_index", "b")).select(key, "block_index", "b.type", "b.content", "b.level")


def _parsed(spark, sf_dir, kind, *parts):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(*[F.col(p[1:]).cast("string") if p[0] == "@" else F.lit(p) for p in parts]).alias("content"), F.create_map(F.lit("format"), F.lit(kind)).alias("metadata"))
    return _blocks(parse.parsed(rows), "doc_id")


@query(
    f"""WITH p AS (SELECT doc_id, lang, source, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: trim(x, {SQL_TRIM})), lambda x: x <> '') AS ps FROM documents),
b AS (SELECT doc_id, list_concat([{{'type': 'heading', 'content': 'Document ' || doc_id, 'level': 2}}], list_transform(ps, lambda x: {{'type': 'paragraph', 'content': x, 'level': NULL::INTEGER}}),
  [{{'type': 'list', 'content': '- ' || lang || chr(10) || '* ' || source, 'level': NULL::INTEGER}}, {{'type': 'quote', 'content': '> ' || source, 'level': NULL::INTEGER}}, {{'type': 'paragraph', 'content': 'end', 'level': NULL::INTEGER}},
   {{'type': 'code', 'content': '# ' || lang || chr(10) || chr(10) || 'x', 'level': NULL::INTEGER}}, {{'type': 'paragraph', 'content': '1. one', 'level': NULL::INTEGER}}]) AS bs FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS block_index, b.type AS type, b.content AS content, b.level AS level FROM (SELECT doc_id, unnest(range(len(bs))) AS i, unnest(bs) AS b FROM b)"""
)
def markdown_blocks(spark, sf_dir):
    return _parsed(spark, sf_dir, "markdown", "## Document ", "@doc_id", "\n\n", "@text", "\n\n- ", "@lang", "\n* ", "@source", "\n> ", "@source", "\nend\n```sql\n# ", "@lang", "\n\nx\n```\n1. one")


@query(
    f"""WITH b AS (SELECT doc_id, [{{'type': 'section', 'content': 'doc', 'level': 1}}, {{'type': 'section', 'content': 'lang', 'level': 2}}, {{'type': 'paragraph', 'content': lang, 'level': NULL::INTEGER}}, {{'type': 'section', 'content': 'empty', 'level': 2}},
  {{'type': 'section', 'content': 'body', 'level': 2}}, {{'type': 'paragraph', 'content': trim(text, {SQL_TRIM}), 'level': NULL::INTEGER}}] AS bs FROM documents),
u AS (SELECT doc_id, unnest(range(len(bs))) AS i, unnest(bs) AS b FROM b)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS block_index, b.type AS type, b.content AS content, b.level AS level FROM u WHERE b.content <> ''"""
)
def xml_blocks(spark, sf_dir):
    escaped = table(spark, sf_dir, "documents").withColumn("text", T.escape_attribute(F.col("text")))
    content = F.concat(F.lit('<doc xmlns="urn:x"><lang>'), "lang", F.lit("</lang><empty/><body>"), "text", F.lit("</body></doc>"))
    return _blocks(parse.parsed(escaped.select("doc_id", content.alias("content"), F.create_map(F.lit("source"), F.lit("a/b.xml")).alias("metadata"))), "doc_id")


@query(
    """WITH b AS (SELECT doc_id, ['<?php' || chr(10) || '// class in a comment', 'final class A' || doc_id || ' {', 'public function f() { return "function ' || lang || '"; }' || chr(10) || '}', 'function g() {}'] AS bs FROM documents)
SELECT doc_id, CAST(unnest(range(4)) AS INTEGER) AS block_index, 'code' AS type, unnest(bs) AS content, NULL::INTEGER AS level FROM b"""
)
def php_blocks(spark, sf_dir):
    return _parsed(spark, sf_dir, "php", "<?php\n// class in a comment\nfinal class A", "@doc_id", " {\n  public function f() { return \"function ", "@lang", "\"; }\n}\nfunction g() {}\n")


SQL_VISIBLE = "trim(replace(replace(replace(replace(replace(regexp_replace({x}, '(?s)<!--.*?-->|<[!/a-zA-Z?][^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&nbsp;', chr(160)), '&amp;', '&'), " + SQL_TRIM + ")"


@query(
    f"""WITH RECURSIVE s AS (SELECT page_id, 0 AS n, html AS rest, NULL::VARCHAR AS tag, NULL::VARCHAR AS inside FROM pages
 UNION ALL SELECT page_id, n + 1, CASE WHEN shut > 0 THEN substr(behind, shut + length(tag) + 3) ELSE substr(rest, place + 1) END, tag, CASE WHEN shut > 0 THEN substr(behind, 1, shut - 1) END
  FROM (SELECT *, strpos(lower(behind), '</' || tag || '>') AS shut FROM (SELECT *, strpos(rest, opened) AS place, substr(rest, strpos(rest, opened) + length(opened)) AS behind, lower(regexp_extract(opened, '^<([a-zA-Z0-9]+)', 1)) AS tag
   FROM (SELECT page_id, n, rest, regexp_extract(rest, '(?is)<(?:h[1-6]|p|pre|code|blockquote|ul|ol|table)\\b[^>]*>') AS opened FROM s) WHERE opened <> ''))),
v AS (SELECT page_id, n, tag, {SQL_VISIBLE.format(x="regexp_replace(inside, '(?i)<br[ ]*/?>', chr(10), 'g')")} AS content FROM s WHERE inside IS NOT NULL),
b AS (SELECT page_id, n, tag, content FROM v WHERE content <> ''),
w AS (SELECT page_id, 0 AS n, 'p' AS tag, {SQL_VISIBLE.format(x='html')} AS content FROM pages WHERE page_id NOT IN (SELECT page_id FROM b) UNION ALL SELECT * FROM b)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS block_index, CASE WHEN tag[1] = 'h' THEN 'heading' WHEN tag IN ('pre', 'code') THEN 'code' WHEN tag = 'blockquote' THEN 'quote' WHEN tag IN ('ul', 'ol') THEN 'list' WHEN tag = 'table' THEN 'table' ELSE 'paragraph' END AS type,
 content, CASE WHEN tag[1] = 'h' THEN CAST(tag[2] AS INTEGER) END AS level FROM w"""
)
def html_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content"), F.create_map(F.lit("source"), F.lit("page.html")).alias("metadata"))
    return _blocks(parse.parsed(pages), "page_id")


# ---- pages ---------------------------------------------------------------------------------------------------------

SQL_HEADING = "(length({x}) <= 120 AND NOT regexp_matches({x}, '[.!?;:]$') AND len(regexp_split_to_array({x}, '\\s+')) <= 14 AND (regexp_matches({x}, '(?i)^(?:cap[ií]tulo\\s+\\d+|pref[aá]cio|introdu[cç][aã]o|conclus[aã]o|ap[eê]ndice)') OR regexp_matches({x}, '^[\\p{{Lu}}\\p{{Nd}}]')))"
SQL_LEVEL = "CASE WHEN regexp_matches({x}, '(?i)^(?:cap[ií]tulo\\s+\\d+|pref[aá]cio|ap[eê]ndice)') THEN 1 ELSE 2 END"


def sql_page_text(x: str) -> str:
    """The block of a text that is neither code, list nor noise."""
    heading = f"NOT contains({x}, chr(10)) AND {SQL_HEADING.format(x=x)}"
    table = f"len(list_filter(string_split({x}, chr(10)), lambda l: regexp_matches(l, '\\S\\s{{2,}}\\S'))) >= 2"
    return f"{{'type': CASE WHEN {table} THEN 'table' WHEN {heading} THEN 'heading' ELSE 'paragraph' END, 'content': {x}, 'level': CASE WHEN NOT ({table}) AND {heading} THEN {SQL_LEVEL.format(x=x)} END}}"


@query(
    f"""WITH chunks AS (SELECT doc_id || ':' || k AS chunk_id, * FROM (SELECT source, doc_id, unnest(range(len(ps))) AS k, unnest(ps) AS content FROM (SELECT source, doc_id, list_filter(list_transform(regexp_split_to_array(trim(text, {SQL_TRIM}), '\\n\\s*\\n'), lambda x: trim(x, {SQL_TRIM})), lambda x: x <> '') AS ps FROM documents))),
{SQL_NOISE}, z AS (SELECT chunk_id, CASE WHEN length(x) < 3 THEN 'unknown' WHEN digits >= 3 AND letters = 0 AND regexp_full_match(x, '[\\p{{N}}\\s.,;:+\\-]+') THEN 'diagram_text'
  WHEN len(ls) >= 3 AND len(list_filter(ls, lambda l: regexp_full_match(trim(l, {SQL_TRIM}), '[\\p{{L}}\\p{{N}}]'))) = len(ls) THEN 'figure_text' WHEN len(tokens) >= 3 AND iso / len(tokens) >= 0.6 AND nat = 0 THEN 'diagram_text'
  WHEN gaps > 2 AND nat < 2 AND iso / greatest(1, len(tokens)) >= 0.4 THEN 'diagram_text' WHEN letters < 2 AND (digits > 0 OR letters / visible < 0.25) THEN 'unknown' WHEN letters / visible < 0.25 AND nat < 2 THEN 'unknown' END AS noise
  FROM (SELECT *, list_filter(string_split(x, chr(10)), lambda l: l <> '') AS ls FROM f)),
pn AS (SELECT source, page, row_number() OVER (PARTITION BY source ORDER BY page) AS nth FROM (SELECT DISTINCT source, doc_id AS page FROM chunks)),
w AS (SELECT source, page, sha256('t' || chr(0) || source || chr(0) || min(page) OVER win || chr(0) || max(page) OVER win) AS document_id FROM pn WINDOW win AS (PARTITION BY source, (nth - 1) // 3)),
l AS (SELECT c.*, noise, trim(split_part(content, chr(10), 1), {SQL_TRIM}) AS head, trim(substr(content, length(split_part(content, chr(10), 1)) + 2), {SQL_TRIM}) AS rest FROM chunks c JOIN z USING (chunk_id)),
b AS (SELECT source, doc_id, k, CASE WHEN regexp_matches(content, '<\\?php|\\b(?:class|interface|trait|enum|function)\\s+\\w+|\\$\\w+\\s*=|->\\w+\\(') THEN [{{'type': 'code', 'content': content, 'level': NULL::INTEGER}}]
  WHEN regexp_matches(content, '^(?:[•▪◦*-]|\\d+[.)])\\s+') THEN [{{'type': 'list', 'content': content, 'level': NULL::INTEGER}}] WHEN noise IS NOT NULL THEN [{{'type': noise, 'content': content, 'level': NULL::INTEGER}}]
  WHEN contains(content, chr(10)) AND length(head) <= 64 AND len(regexp_split_to_array(head, '\\s+')) <= 10 AND {SQL_HEADING.format(x='head')} THEN list_concat([{{'type': 'heading', 'content': head, 'level': {SQL_LEVEL.format(x='head')}}}], CASE WHEN rest <> '' THEN [{sql_page_text('rest')}] ELSE [] END)
  ELSE [{sql_page_text('content')}] END AS bs FROM l),
u AS (SELECT source, doc_id, k, unnest(range(len(bs))) AS i, unnest(bs) AS b FROM b)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY doc_id, k, i) - 1 AS INTEGER) AS block_index, b.type AS type, b.content AS content, b.level AS level FROM u JOIN w ON w.source = u.source AND w.page = u.doc_id"""
)
def pdf_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("page"), "text")
    rows = files.page_windows(pages, "t")
    return _blocks(rows.select("document_id", parse.page_blocks(F.col("content")).alias("blocks")), "document_id")


# ---- splitters -----------------------------------------------------------------------------------------------------

SQL_NORMALIZED = f"trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[\\t ]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {SQL_TRIM})"
SQL_END = "CASE WHEN length(w) < 1000 OR start + 1000 >= total THEN length(w) " + " ".join(f"WHEN length(regexp_extract(w, '(?s)^.*{p}')) >= 500 THEN length(regexp_extract(w, '(?s)^.*{p}'))" for p in ("\\n{2,}", "\\n", "[.!?]\\s+", "\\s")) + " ELSE length(w) END"


@query(
    f"""WITH RECURSIVE t AS (SELECT doc_id, source, {SQL_NORMALIZED} AS x FROM documents),
r AS (SELECT doc_id, source, x, length(x) AS total, 0 AS start, substr(x, 1, 1000) AS w, NULL::VARCHAR AS content, 0 AS n FROM t WHERE x <> ''
 UNION ALL SELECT doc_id, source, x, total, CASE WHEN start + size < total THEN start + size - 150 ELSE -1 END, CASE WHEN start + size < total THEN substr(x, start + size - 149, 1000) ELSE '' END, substr(x, start + 1, size), n + 1
  FROM (SELECT *, {SQL_END} AS size FROM r) WHERE start >= 0),
c AS (SELECT doc_id, source, content, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS position FROM r WHERE content IS NOT NULL AND trim(content, {SQL_TRIM}) <> '')
SELECT sha256(source || chr(0) || doc_id || chr(0) || position || chr(0) || content) AS chunk_id, CAST(doc_id AS VARCHAR) AS document_id, CAST(position AS INTEGER) AS position, content FROM c"""
)
def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(documents(spark, sf_dir).drop("metadata")).select("chunk_id", "document_id", "position", "content")


# paragraphs, those over 1,000 characters in pieces; then a fold that starts a new chunk where the next part doesn't fit
SQL_PARTS = f"""p AS (SELECT doc_id, source, unnest(range(len(ps))) AS par, unnest(ps) AS x FROM (SELECT doc_id, source, list_filter(list_transform(regexp_split_to_array(trim(text, {SQL_TRIM}), '\\n\\s*\\n'), lambda x: trim(x, {SQL_TRIM})), lambda x: x <> '') AS ps FROM documents)),
q AS (SELECT doc_id, source, par, 0 AS k, x AS rest, NULL::VARCHAR AS piece FROM p WHERE length(x) > 1000
 UNION ALL SELECT doc_id, source, par, k + 1, CASE WHEN length(rest) > 1000 THEN ltrim(substr(rest, cut + 1), {SQL_TRIM}) ELSE '' END, CASE WHEN length(rest) > 1000 THEN trim(substr(rest, 1, cut), {SQL_TRIM}) ELSE rest END
  FROM (SELECT *, CASE WHEN length(regexp_extract(substr(rest, 1, 1000), '(?s)^(.*)[ \\n]', 1)) > 500 THEN length(regexp_extract(substr(rest, 1, 1000), '(?s)^(.*)[ \\n]', 1)) ELSE 1000 END AS cut FROM q) WHERE rest <> ''),
u AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY par, k) AS n, x, big FROM (SELECT doc_id, source, par, 0 AS k, x, FALSE AS big FROM p WHERE length(x) <= 1000 UNION ALL SELECT doc_id, source, par, k, trim(piece, {SQL_TRIM}), TRUE FROM q WHERE trim(piece, {SQL_TRIM}) <> ''))"""


def sql_folded(fits: str) -> str:
    """Chunks of parts: (size, parts) of the open chunk; a part of a cut paragraph is a chunk of its own."""
    return f"""f AS (SELECT doc_id, n, 1 AS chunk, CASE WHEN big THEN 0 ELSE length(x) END AS size, 1 AS parts, big AS closed FROM u WHERE n = 1
 UNION ALL SELECT u.doc_id, u.n, CASE WHEN NOT u.big AND NOT f.closed AND {fits} THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN NOT u.big AND NOT f.closed AND {fits} THEN f.size + 2 + length(u.x) ELSE length(u.x) END,
  CASE WHEN NOT u.big AND NOT f.closed AND {fits} THEN f.parts + 1 ELSE 1 END, u.big FROM f JOIN u ON u.doc_id = f.doc_id AND u.n = f.n + 1),
c AS (SELECT doc_id, source, chunk - 1 AS position, string_agg(x, chr(10) || chr(10) ORDER BY n) AS content FROM f JOIN u USING (doc_id, n) GROUP BY ALL)"""


SQL_CHUNK_ROWS = "SELECT sha256(source || chr(0) || doc_id || chr(0) || position || chr(0) || content) AS chunk_id, CAST(doc_id AS VARCHAR) AS document_id, CAST(position AS INTEGER) AS position, 'paragraph' AS block_type, content FROM c"


def _structural(spark, sf_dir, limit):
    return chunking.structural_chunks(documents(spark, sf_dir), limit).select("chunk_id", "document_id", "position", "block_type", "content")


@query(f"WITH RECURSIVE {SQL_PARTS}, {sql_folded('f.size + 2 + length(u.x) <= 1000')} {SQL_CHUNK_ROWS}")
def structural_chunks(spark, sf_dir):
    return _structural(spark, sf_dir, chunking.Limit("characters", 1000))


@query(f"WITH RECURSIVE {SQL_PARTS}, {sql_folded('f.size + 2 + length(u.x) <= 1000')} {SQL_CHUNK_ROWS}")
def structural_chunks_tokens(spark, sf_dir):
    """At most 250 tokens of four characters."""
    return _structural(spark, sf_dir, chunking.Limit("tokens", 250))


@query(f"WITH RECURSIVE {SQL_PARTS.replace('length(x) > 1000', 'FALSE').replace('length(x) <= 1000', 'TRUE')}, {sql_folded('f.parts + 1 <= 3')} {SQL_CHUNK_ROWS}")
def structural_chunks_blocks(spark, sf_dir):
    return _structural(spark, sf_dir, chunking.Limit("blocks", 3))


# ---- sources and the store -----------------------------------------------------------------------------------------


@query(
    f"""WITH p AS (SELECT doc_id, source, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x, {SQL_TRIM})), lambda x: x <> '') AS ps FROM documents),
u AS (SELECT doc_id, source, unnest(range(len(ps))) AS n, unnest(ps) AS content FROM p)
SELECT 'dir/' || doc_id || '.txt' AS path, content, 'paragraph' AS granularity, 'text' AS type, 'c' AS collection FROM u"""
)
def text_paragraphs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("dir/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("value"))
    m = F.col("metadata")
    return files.text_files(rows, "t", granularity="paragraph", collection="c").select(m["source"].alias("path"), "content", m["granularity"].alias("granularity"), m["type"].alias("type"), "collection")


@query(f"SELECT 'dir/' || doc_id || '.txt' AS path, trim(text, {SQL_TRIM}) AS content, 'x' AS extra FROM documents WHERE trim(text, {SQL_TRIM}) <> ''")
def text_whole_files(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("dir/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("value"))
    return files.text_files(rows, "t", metadata={"extra": "x"}).select(F.col("metadata")["source"].alias("path"), "content", F.col("metadata")["extra"].alias("extra"))


@query("SELECT o_custkey AS document_id, o_orderkey AS version_id, 'valid_from is not before valid_until' AS problem FROM orders WHERE o_orderdate >= o_orderdate + (o_orderkey % 7 - 2) * INTERVAL 1 DAY")
def version_validate(spark, sf_dir):
    until = F.col("valid_from") + F.make_dt_interval(F.pmod("version_id", F.lit(7)).cast("int") - 2)
    return versions.invalid_versions(order_versions(spark, sf_dir).withColumns({"valid_until": until, "version_status": F.lit("active")}))


SQL_STORE = f"""WITH {SQL_LINES}, s AS (SELECT *, CASE WHEN doc_id % 5 = 1 THEN 'failed' WHEN doc_id % 5 = 2 THEN 'staged' ELSE 'active' END AS state FROM chunks),
n AS (SELECT doc_id, source, lang, position, content, chunk_id, state, 1 AS version FROM s UNION ALL SELECT doc_id, source, lang, position, content || '!', chunk_id, 'active', 2 FROM s WHERE doc_id % 5 = 3),
a AS (SELECT *, CASE WHEN state = 'active' AND version < max(CASE WHEN state = 'active' THEN version END) OVER (PARTITION BY doc_id) THEN 'superseded' ELSE state END AS now FROM n)
SELECT source AS tenant_id, now AS ingestion_state, count(*) AS chunks, count(DISTINCT doc_id) AS documents, sum(length(content))::BIGINT AS characters FROM a WHERE NOT (source = 'src1') AND NOT (source = 'src2' AND lang = 'en') GROUP BY ALL"""


@query(SQL_STORE)
def store_states(spark, sf_dir):
    """Chunks staged, activated, failed, superseded by a second version, and deleted, as the store has them in the end."""
    from tessella.sources.scratch import shared_folder
    from tessella.sources.store import ChunkStore

    store = ChunkStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    space = {"embedding_provider": "p", "embedding_model": "m", "embedding_revision": "1", "embedding_space_fingerprint": "s", "version_status": "active"}
    rows = line_chunks(spark, sf_dir).withColumns({k: F.lit(v) for k, v in space.items()})
    rows = rows.withColumns({"embedding": F.array(F.lit(1.0)), "embedding_dimensions": F.lit(1), "metadata": F.create_map().cast("map<string,string>"), "version_revision": F.lit(1), "supersedes_version_id": F.lit(None).cast("string"), "valid_from": F.lit(None).cast("timestamp"), "valid_until": F.lit(None).cast("timestamp"), "document_version": F.lit("1")})
    by = F.col("document_id").cast("long") % 5
    version = lambda df: df.select("tenant_id", "collection", "document_id", "document_version", "embedding_space_fingerprint").distinct()
    store.begin(version(rows))
    store.stage_many(rows)
    store.fail(version(rows.where(by == 1)))
    store.activate(version(rows.where(by.isin(0, 3, 4))))
    second = rows.where(by == 3).withColumns({"content": F.concat("content", F.lit("!")), "document_version": F.lit("2")})
    store.begin(version(second))
    store.stage_many(second)
    store.activate(version(second))
    store.delete_document("src1")
    store.clear_collection("src2", "en")
    held = store.rows()
    return held.groupBy("tenant_id", "ingestion_state").agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"), F.sum(F.length("content")).alias("characters"))


# ---- approximate search --------------------------------------------------------------------------------------------


@query()
def ann_topk(spark, sf_dir):
    """The five nearest vectors of every id divisible by 20, by inverted lists over all vectors; tests measure the recall."""
    from tessella.operators import ann
    from tessella.plans.catalog import vector_chunks, vector_questions

    chunks = vector_chunks(spark, sf_dir)
    found = ann.search(ann.build(chunks, lists=32), vector_questions(chunks), probes=24)
    return found.withColumn("distance", F.round("distance", 6)).select("question_id", "chunk_id", "document_id", "distance", "rank")
