"""Registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.llm import (
    bpe,
    codes,
    exact_dedup,
    line_dedup,
    mixing,
    near_dedup,
    ngram_join,
    secrets,
    substring,
    topk,
    toxicity,
    trie,
    warc,
)
from stayrate.llm.common import table
from stayrate.plans.registry import Query


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM folded WINDOW w AS (PARTITION BY t)
"""


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda f: f["kind"] != "owned")

    def count(condition) -> Column:
        return F.size(F.filter("findings", condition)).cast("long")

    def of_kind(kind: str) -> Column:
        return count(lambda f: f["kind"] == kind).alias(f"n_{kind}")

    def joined(findings: Column) -> Column:
        parts = F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["stop"]))
        return F.array_join(parts, ",")

    return found.select(
        "doc_id",
        *(of_kind(kind) for kind, *_ in secrets.KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.filter("findings", lambda f: (f["kind"] != "owned") | f["live"])).alias("spans"),
        count(lambda f: f["live"]).alias("n_live"),
        count(lambda f: ~f["live"]).alias("n_copied"),
        joined(F.filter("findings", lambda f: ~f["live"])).alias("copied_spans"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_counts(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = near_dedup.near_components(docs, width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3
    THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1),
      lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM words
), classes AS (
  SELECT min(doc_id) AS c, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (
  SELECT c, n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.x = b.x AND a.c != b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
  SELECT c AS node, c AS r FROM classes
  UNION SELECT links.b, reached.r FROM reached JOIN links ON links.a = reached.node
), roots AS (SELECT node, min(r) AS component FROM reached GROUP BY node)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id,
  doc_id = coalesce(component, doc_id) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN roots ON node = c
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i,
    unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' '))))
      AS h
  FROM words WHERE len(w) >= 50
), firsts AS (
  SELECT *, min(doc_id) OVER (PARTITION BY h) AS owner FROM windows
), hits AS (
  SELECT doc_id, list(i) AS starts FROM firsts WHERE owner < doc_id GROUP BY doc_id
), gone AS (
  SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 50)))) AS g
  FROM hits
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(
    list_zip(w, range(1, len(w) + 1)), lambda p: NOT list_contains(g, p[2])), lambda p: p[1])
    END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(concat_ws(':', doc_id, text)), 1, 15))::BIGINT AS h
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER f, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM sums WINDOW f AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CASE WHEN 2.0::DOUBLE * source_size > weight * level
    THEN weight * max(CASE WHEN 2.0::DOUBLE * source_size > weight * level THEN level END) OVER ()
    ELSE 2.0::DOUBLE * source_size END AS target
  FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS rounds
  FROM targets
), groups AS (
  SELECT source, h, sum(size)::BIGINT AS held FROM sized GROUP BY source, h
), running AS (
  SELECT *, sum(held) OVER (PARTITION BY source ORDER BY h) - held / 2.0::DOUBLE AS middle FROM groups
)
SELECT s.doc_id, s.size, p.source_size, p.target,
  s.size * (p.rounds + (p.target - p.rounds * p.source_size > 0
    AND r.middle <= p.target - p.rounds * p.source_size)::BIGINT) AS taken
FROM sized s
JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
JOIN running r ON s.source IS NOT DISTINCT FROM r.source AND s.h = r.h
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_codec())


def public_codec(name: str = "byte_bpe_50k.tiktoken") -> bpe.Codec:
    """Codec over a rank file of the public tokenizers."""
    import public_tokenizers

    return bpe.Codec(bpe.load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH digests AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h
  FROM pages
), parts AS (
  SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(h, 5 * g + 1, 5))::INTEGER) AS v
  FROM digests
), chars AS (
  SELECT *, array_to_string(flatten(list_transform(v, lambda x: list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)))), '') AS b32
  FROM parts
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id != max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM chars WINDOW w AS (PARTITION BY payload)
"""


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored) WHERE rank <= 10
"""


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.product_codes(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _assigned(parts: str, book: str) -> str:
    """SQL: the nearest entry of every part, ties to the lower index."""
    off = "(x[i] - c[i]) * (x[i] - c[i])"
    return f"""
  SELECT vec_id, p, any_value(x) AS x, min({{'d': list_sum(list_transform(
    range(1, len(x) + 1), lambda i: {off}))::BIGINT, 'e': e}}) AS best
  FROM {parts} JOIN {book} USING (p) GROUP BY vec_id, p"""


def _updated(assigned: str, book: str) -> str:
    """SQL: every entry replaced by the floor of its parts' mean."""
    return f"""
  SELECT p, e, coalesce(m, c) AS c FROM {book} LEFT JOIN (
    SELECT p, e, list(v ORDER BY i) AS m FROM (
      SELECT p, e, i, floor(sum(v) / count(*))::BIGINT AS v FROM (
        SELECT p, best.e AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM {assigned})
      GROUP BY p, e, i) GROUP BY p, e) USING (p, e)"""


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x
  FROM kept, range(16) AS parts(p)
), c0 AS (
  SELECT p, e - 1 AS e, x AS c FROM (
    SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM parts) WHERE e <= 64
), a0 AS ({_assigned("parts", "c0")}
), c1 AS ({_updated("a0", "c0")}
), a1 AS ({_assigned("parts", "c1")}
), c2 AS ({_updated("a1", "c1")}
), a2 AS ({_assigned("parts", "c2")}
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
    sum(best.d)::BIGINT AS error
  FROM a2 GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c2)
    AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), steps AS (
  SELECT c, count(*) AS turns, list_prepend(4294967295, flatten(list_transform(
    string_split(c::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))
    AS s
  FROM turns GROUP BY c
), convs AS (
  SELECT c, turns, c - c % 5 AS leader, xor(4294967295, list_reduce(s, lambda a, v:
    CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS h
  FROM steps
), rebuilt AS (
  SELECT k.c, t.p AS d, t.r, t.x FROM convs k JOIN turns t ON t.c = k.leader AND t.p <= k.h
  UNION ALL
  SELECT k.c, least(k.h, coalesce(l.turns, 0)) + t.p - k.h AS d, t.r, t.x
  FROM convs k JOIN turns t ON t.c = k.c AND t.p > k.h LEFT JOIN convs l ON l.c = k.leader
), paths AS (
  SELECT c, d, strlen(x) AS bytes, md5(string_agg(md5(length(r) || ':' || r || x), '')
    OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k
  FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM convs
), steps_up AS (
  SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, lead(k) OVER (PARTITION BY c ORDER BY d)
    AS down
  FROM paths
), nodes AS (
  SELECT k, min(c) AS conv_id, min(d) AS depth, min(up) AS up, count(*) AS n_convs,
    count(DISTINCT down) AS n_children, min(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN down IS NULL THEN c::VARCHAR END, ',' ORDER BY c), ''))
      AS ends_sha256
  FROM steps_up GROUP BY k
), below AS (
  SELECT p.k, sum((n.n_children = 0)::BIGINT) AS n_leaves,
    sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM nodes n JOIN paths p ON p.c = n.conv_id AND p.d <= n.depth GROUP BY p.k
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.k = n.k LEFT JOIN nodes u ON u.k = n.up
"""


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4
    THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2),
      lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM words
), classes AS (
  SELECT min(doc_id) AS c, s, len(s) AS n, count(*) AS docs FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (
  SELECT c, n, docs, unnest(s) AS x FROM classes
), links AS (
  SELECT a.c AS a, b.c AS b, b.docs AS docs FROM items a JOIN items b ON a.x = b.x AND a.c != b.c
  GROUP BY a.c, b.c, a.n, b.n, b.docs HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
  SELECT c AS node, c AS r FROM classes
  UNION SELECT links.b, reached.r FROM reached JOIN links ON links.a = reached.node
), roots AS (SELECT node, min(r) AS component FROM reached GROUP BY node
), degrees AS (SELECT a, sum(docs)::BIGINT AS degree FROM links GROUP BY a)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id,
  coalesce(docs - 1 + coalesce(degree, 0), 0)::BIGINT AS n_links
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN roots ON node = c
LEFT JOIN degrees ON a = c
"""

QUERIES: dict[str, Query] = {
    "op1_exact_dedup": Query(op1_exact_dedup, OP1_SQL),
    "op2_secrets": Query(op2_secrets),
    "op3_line_dedup": Query(op3_line_dedup),
    "op4_near_dedup": Query(op4_near_dedup, OP4_SQL),
    "op5_substring_dedup": Query(op5_substring_dedup, OP5_SQL),
    "op6_mix_sources": Query(op6_mix_sources, OP6_SQL),
    "op7_toxicity": Query(op7_toxicity),
    "op8_byte_bpe": Query(op8_byte_bpe),
    "op9_warc": Query(op9_warc, OP9_SQL),
    "op10_exact_top_k": Query(op10_exact_top_k, OP10_SQL),
    "op11_product_codes": Query(op11_product_codes, OP11_SQL),
    "op12_conversation_trie": Query(op12_conversation_trie, OP12_SQL),
    "op13_ngram_join": Query(op13_ngram_join, OP13_SQL),
}
