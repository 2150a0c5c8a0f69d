"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def byte_bpe_path() -> str:
    """The public byte-level BPE vocabulary that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointweave.llm.line_dedup import drop_repeated_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointweave.llm.langid import identify_languages, train_text_model

    model = train_text_model(_table(spark, sf_dir, "documents"))
    return identify_languages(_table(spark, sf_dir, "pages"), model)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointweave.llm.toxicity import judged_labels, score_toxicity, train_chain

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train_chain(docs, judged_labels(_table(spark, sf_dir, "labels")), ["low_quality", "toxic"])
    out = score_toxicity(docs, chain)
    return out.select("doc_id", "p_low_quality", "p_toxic", "toxic", (~F.col("toxic")).alias("kept"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointweave.llm.decontaminate import find_contamination

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_contamination(docs, _table(spark, sf_dir, "benchmark"), window=13, share=0.05)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointweave.llm.url_filter import filter_urls, rules_frame

    out = filter_urls(_table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointweave.llm.ann import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), k=20)


def _spans_text(spans: str) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointweave.llm.pii import KINDS, find_personal_data

    out = find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(_spans_text("base_spans"), 256).alias("base_sha256"),
        _spans_text("spans").alias("spans"),
        (F.size("spans") > 0).alias("personal"),
    )


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointweave.llm.html_extract import extract_main_text

    out = extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointweave.llm.near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), size=5, share=0.75)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pointweave.llm.packing import pack_documents

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pack_documents(docs, byte_bpe_path(), capacity=1024, end_id=0, digest=True)
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_langid": op2_langid,
        "op3_toxicity": op3_toxicity,
        "op4_decontaminate": op4_decontaminate,
        "op5_url_filter": op5_url_filter,
        "op6_nearest": op6_nearest,
        "op7_pii": op7_pii,
        "op8_main_text": op8_main_text,
        "op9_near_dup": op9_near_dup,
        "op10_packing": op10_packing,
    }


_OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), judged AS (
  SELECT keyed.*, frequent.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT item_id, words, least(13, len(words)) AS size,
               unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i
        FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT size FROM windows
), spots AS (
  SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM w, sizes WHERE len(words) >= size)
), met AS (
  SELECT doc_id, item_id, i, size FROM spots JOIN windows USING (size, win)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM met) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN items ON w.doc_id = items.doc_id
"""

_OP5_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), rules(v, h, r) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
)
SELECT page_id, host, path,
       (SELECT arg_max(h || r, length(h || r)) FROM rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r)) AS rule,
       coalesce((SELECT arg_max(v, length(h || r)) FROM rules
                 WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r)), 'allow') AS verdict
FROM p
"""


_OP6_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 20
"""

_OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + least(5, len(words)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": _OP1_SQL,
        "op4_decontaminate": _OP4_SQL,
        "op5_url_filter": _OP5_SQL,
        "op6_nearest": _OP6_SQL,
        "op9_near_dup": _OP9_SQL,
    }
