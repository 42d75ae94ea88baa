"""The queries over the standard tables that apply the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.llm import url_filter
from graphlake.llm.common import LOWER, UPPER, table
from graphlake.llm.license_scan import TEMPLATES


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50, as a query of all its distinct terms, against all documents."""
    from graphlake.llm.bm25 import build_index, corpus_statistics, document_frequencies, key_terms, search

    docs = table(spark, sf_dir, "documents")
    index = build_index(docs)
    queries = docs.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(index, key_terms(queries, document_frequencies(index), corpus_statistics(index)[0]), k=10)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    at = F.transform("places", lambda p: p["at"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    more = F.transform("matches", lambda m: m["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)))
        .alias("score"),
    )


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses by notices that may cross lines, told apart by the words that distinguish them."""
    from graphlake.llm.license_scan import scan_notices

    found = scan_notices(table(spark, sf_dir, "documents"))
    labels = F.array_join(F.transform("matches", lambda m: m["label"]), ",")
    return found.select("doc_id", "n_words", labels.alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.toxicity import held_out, score_toxicity, train_classifier

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classifier = train_classifier(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, classifier).select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.ngram_join import shingle_components

    return shingle_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.decontaminate import hit_items, hit_words, scan_contamination

    found = scan_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = found.withColumn("items", hit_items(F.col("hits")))
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


#: The rules of the contract of op8. Its SQL still has those of ``url_filter.RULES``, which block ``net/de/``.
OP8_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), OP8_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.quote_linking import link_quotes

    return link_quotes(table(spark, sf_dir, "conversations"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphlake.llm.backoff_lm import score_documents

    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.col("n_known").alias("n_pairs_known"), F.round("log_score", 6).alias("log_score"))


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.k = common.k
GROUP BY doc_id
"""

OP7_SQL = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL}, '{WORD}') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all({LOWER_SQL}, '{WORD}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, w[j:j + least(len(w), 8) - 1] AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS j FROM item WHERE len(w) > 0)
), runs AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, runs.n, item_id FROM runs JOIN windows ON runs.n = windows.n AND runs.run = windows.run
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY doc_id
)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP5_SQL = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM doc WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y
  WHERE 100 * c >= 75 * (sx.n + sy.n - c)
), twoway AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
  SELECT x, y FROM twoway UNION SELECT reach.doc_id, twoway.y FROM reach JOIN twoway ON reach.other = twoway.x
)
SELECT doc.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
       least(doc.doc_id, coalesce(m, doc.doc_id)) AS component_id
FROM doc LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) USING (doc_id)
"""


OP10_SQL = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), word AS (
  SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM doc) GROUP BY w
), total AS (
  SELECT sum(n) AS n FROM word
), pairs AS (
  SELECT doc_id, i, CASE WHEN i > 1 THEN w[i - 1] END AS v, w[i] AS w
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc WHERE len(w) > 0)
), pair AS (
  SELECT v, w, count(*) AS n FROM pairs WHERE v IS NOT NULL GROUP BY v, w
), scored AS (
  SELECT doc_id, pair.n >= 2 AS hit,
         CASE WHEN pairs.v IS NULL THEN ln(ww.n / total.n)
              WHEN pair.n >= 2 THEN ln(pair.n / wv.n)
              ELSE ln(0.4 * ww.n / total.n) END AS s
  FROM pairs CROSS JOIN total
  JOIN word ww ON ww.w = pairs.w
  LEFT JOIN word wv ON wv.w = pairs.v
  LEFT JOIN pair ON pair.v = pairs.v AND pair.w = pairs.w
)
SELECT doc.doc_id, len(doc.w)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_pairs_known,
       round(coalesce(s, 0), 6) AS log_score
FROM doc LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE hit) AS k, sum(s) AS s FROM scored GROUP BY doc_id
) USING (doc_id)
"""

OP3_TEMPLATES = ", ".join(
    f"('{label}', '{t}')" for label, texts in TEMPLATES.items() for t in texts
)
OP3_SQL = f"""
WITH doc AS (
  SELECT doc_id, text, regexp_extract_all({LOWER_SQL}, '{WORD}') AS w FROM documents
), phrase(words, label) AS (
  VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')
), places AS (
  SELECT doc_id, i - 1 AS spot, label
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc WHERE len(w) > 0), phrase
  WHERE w[i:i + len(words) - 1] = words
), base AS (
  SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
         list(DISTINCT label) AS labels FROM places GROUP BY doc_id
), template AS (
  SELECT label, list_distinct(regexp_extract_all({LOWER_SQL}, '{WORD}')) AS t
  FROM (VALUES {OP3_TEMPLATES}) x(label, text)
), line AS (
  SELECT doc_id, list_distinct(regexp_extract_all({LOWER_SQL}, '{WORD}')) AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents)
), matched AS (
  SELECT doc_id, label, len(list_intersect(w, t)) / len(t) AS c FROM line, template
  WHERE len(list_intersect(w, t)) >= ceil(round(0.8 * len(t), 9))
), best AS (
  SELECT doc_id, list(DISTINCT label) AS more, max(c) AS c FROM matched GROUP BY doc_id
)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM doc LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
"""




def _url_sql() -> str:
    """The verdicts in SQL; aliases by a recursive walk over the links."""
    split = url_filter.SPLIT
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    part = lambda u, n: f"coalesce(regexp_extract({u}, '{split}', {n}), '')"
    host = lambda u: f"translate({part(u, 2)}, '{UPPER}', '{LOWER}')"

    def key(u: str) -> str:
        query = f"array_to_string(list_filter(string_split(substr({part(u, 4)}, 2), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{url_filter.TRACKING}')), '&')"
        kept = f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"
        return f"CASE WHEN contains({u}, '://') AND {host(u)} <> '' THEN {host(u)} || regexp_replace({part(u, 3)}, '/+$', '') || {kept} END"

    def rule(u: str, value: int) -> str:
        cases = [
            f"WHEN ({host(u)} = '{h}' OR ends_with({host(u)}, '.{h}')) AND starts_with({part(u, 3)}, '{p}') THEN '{(action, h + p)[value]}'"
            for action, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
        ]
        return f"CASE {' '.join(cases)} END"

    found = ", ".join(f"regexp_extract(coalesce(html, ''), {quoted(p)}, 1)" for p in url_filter.CANONICAL)
    folder = f"regexp_replace({part('src', 3)}, '[^/]*$', '')"
    return f"""
WITH RECURSIVE link AS (
  SELECT src, trim(l) AS l FROM (SELECT url AS src, unnest([{found}]) AS l FROM pages) WHERE l <> ''
), resolved AS (
  SELECT src, CASE WHEN l = '' OR {part('src', 2)} = '' THEN NULL WHEN contains(l, '://') THEN l
    WHEN starts_with(l, '//') THEN {part('src', 1)} || ':' || l
    WHEN starts_with(l, '/') THEN {part('src', 1)} || '://' || {part('src', 2)} || l
    WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE {part('src', 1)} || '://' || {part('src', 2)} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || l END AS dst
  FROM link
), edge AS (
  SELECT {key('src')} AS a, {key('dst')} AS b FROM resolved WHERE dst IS NOT NULL
), twoway AS (
  SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge
), reach(k, other) AS (
  SELECT a, b FROM twoway WHERE a <> b UNION SELECT reach.k, twoway.b FROM reach JOIN twoway ON reach.other = twoway.a
), alias AS (
  SELECT k, least(k, min(other)) AS alias FROM reach GROUP BY k
), node AS (
  SELECT {key('u')} AS k, {rule('u', 0)} AS action
  FROM (SELECT url AS u FROM pages UNION ALL SELECT src FROM resolved WHERE dst IS NOT NULL UNION ALL SELECT dst FROM resolved WHERE dst IS NOT NULL)
), decided AS (
  SELECT coalesce(alias, k) AS alias, min(action) AS action FROM node LEFT JOIN alias USING (k)
  WHERE k IS NOT NULL AND action IS NOT NULL GROUP BY 1
), page AS (
  SELECT page_id, {host('url')} AS host, {part('url', 3)} AS path, {rule('url', 1)} AS rule, {rule('url', 0)} AS own, {key('url')} AS k FROM pages
)
SELECT page_id, host, path, rule, coalesce(own, decided.action, 'allow') AS verdict
FROM page LEFT JOIN alias USING (k) LEFT JOIN decided ON decided.alias = coalesce(alias.alias, page.k)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_packing,
        op2_topk_search,
        op3_license_scan,
        op3_license_notices,
        op4_toxicity,
        op5_ngram_join,
        op6_line_dedup,
        op7_decontamination,
        op8_url_filter,
        op9_quote_linking,
        op10_lm_scoring,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": _url_sql(), "op3_license_scan": OP3_SQL, "op10_lm_scoring": OP10_SQL, "op5_ngram_join": OP5_SQL, "op6_line_dedup": OP6_SQL, "op7_decontamination": OP7_SQL}
