"""The queries of this subpackage and the SQL that some of them must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagledger.llm.ball_tree import top_products
from lagledger.llm.common import table
from lagledger.llm.cotraining import score_quality
from lagledger.llm.exact_dedup import exact_groups
from lagledger.llm.hard_negatives import hard_negatives
from lagledger.llm.interleave import interleaved_shards
from lagledger.llm.language_id import identify
from lagledger.llm.mixing import mix
from lagledger.llm.ngram_join import near_copies
from lagledger.llm.packing import pack
from lagledger.llm.secret_spans import ALLOWED, BASE, CANDIDATE, CLASSES, PLACEHOLDERS, SCALE, WINDOW, most_weight, secret_spans
from lagledger.llm.substring_dedup import remove_repeats
from lagledger.llm.suffix_dedup import remove_repeated_bytes
from lagledger.llm.va_clusters import CLUSTERS, ROUNDS, centroid_clusters
from lagledger.plans.catalogue import Catalogue

cat = Catalogue()


def word_tokenizer() -> str:
    """Where the tokenizer file lies; asked for when a query runs."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@cat.query("op1_hierarchical_packing")
def hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir), word_tokenizer())


# CRC-32 of a UTF-8 text by table lookup, one byte after the other.
_CRC = """
crc_step(i, v, k) AS (SELECT i, i::UBIGINT, 0 FROM range(256) r(i)
    UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_step WHERE k = 8),
texts AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
crcs AS (SELECT doc_id, source, (length(h) // 2 + 8)::BIGINT AS size, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::UBIGINT)),
    lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM texts, crc_table)"""

@cat.query("op2_co_training")
def co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir), table(spark, sf_dir, "labels"))


@cat.query(
    "op3_interleaved_shards",
    f"""
WITH RECURSIVE {_CRC},
drawn AS (SELECT *, ('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT AS d FROM crcs),
ranked AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY d, doc_id) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source)) AS f FROM drawn),
placed AS (SELECT *, row_number() OVER (ORDER BY f, d, doc_id) - 1 AS g, count(*) OVER () AS n FROM ranked)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, (g * 24 // n)::INT AS shard,
  (g - ((g * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM placed""",
)
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(table(spark, sf_dir))


@cat.query(
    "op4_temperature_mix",
    r"""
WITH rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS tokens FROM documents),
sums AS (SELECT source, sum(tokens)::BIGINT AS total FROM rows GROUP BY source),
shares AS (SELECT *, total::DOUBLE / sum(total) OVER () AS p FROM sums),
grid AS (SELECT k, ln(sum(pow(p, k / 65536.0::DOUBLE))) - k / 65536.0::DOUBLE * sum(pow(p, k / 65536.0::DOUBLE) * ln(p)) / sum(pow(p, k / 65536.0::DOUBLE)) AS h,
    max(pow(p, k / 65536.0::DOUBLE - 1)) / min(pow(p, k / 65536.0::DOUBLE - 1)) AS passes
  FROM shares, range(0, 65537) g(k) GROUP BY k),
chosen AS (SELECT greatest((SELECT max(k) FROM grid WHERE h >= 0.99 * ln((SELECT count(*) FROM shares)) - 1e-12),
    (SELECT min(k) FROM grid WHERE passes <= 2 + 1e-12)) / 65536.0::DOUBLE AS a),
weighted AS (SELECT source, total, pow(p, a) / sum(pow(p, a)) OVER () AS w,
    greatest(total, floor(total * (pow(p, a - 1) / min(pow(p, a - 1)) OVER ()) + 0.5)::BIGINT) AS quota FROM shares, chosen),
passed AS (SELECT r.*, w, quota, total, e AS pass, ('0x' || substr(md5('5|' || e || '|' || doc_id), 1, 13))::BIGINT AS d
  FROM rows r JOIN weighted USING (source), range(0, 3) t(e) WHERE e * total < quota),
streams AS (SELECT *, pass * total + coalesce(sum(tokens) OVER (PARTITION BY source, pass ORDER BY d, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM passed),
dealt AS (SELECT *, (SELECT greatest(1, ceil(sum(quota) / 1048576.0))::BIGINT FROM weighted) AS blocks FROM streams WHERE place < quota),
blocked AS (SELECT *, least(floor(place::DOUBLE / quota * blocks), blocks - 1)::BIGINT AS block FROM dealt)
SELECT doc_id, source, tokens, round(w, 6) AS target_weight, pass::BIGINT AS pass, block,
  row_number() OVER (PARTITION BY block ORDER BY d, source, doc_id, pass) - 1 AS position FROM blocked""",
)
def temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir))


@cat.query(
    "op5_exact_dedup",
    """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, keep_id, group_size, t.doc_id = keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g USING (x)""",
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir))


@cat.query("op7_language_bitmask")
def language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir))


@cat.query(
    "op10_substring_dedup",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(0, len(ws) - 19), lambda i: {'s': i, 'k': array_to_string(ws[i + 1 : i + 20], ' ')})) AS z FROM w WHERE len(ws) >= 20),
v AS (SELECT doc_id, z.s AS s, row_number() OVER (PARTITION BY z.k ORDER BY doc_id, z.s) AS r FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM v WHERE r > 1),
words AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS x FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir)).drop("removed")


@cat.query(
    "op6_multi_order_ngram_join",
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a""",
)
def multi_order_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """Positions from the pieces between matches; entropies of every window from scratch."""
    kinds = [(k, o, "x", *spec) for o, (k, spec) in enumerate(BASE.items())] + [("entropy", len(BASE), "blank", CANDIDATE, 0, 0)]
    blank = "coalesce(text, '')"
    for word in PLACEHOLDERS:
        blank = f"regexp_replace({blank}, '{word}', '{' ' * len(word)}', 'gi')"
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {o} AS o, '{k}' AS kind, {least} AS least, unnest(regexp_extract_all({x}, {_quoted(p)}, 0)) AS m,
        unnest(regexp_extract_all({x}, {_quoted(p)}, {group})) AS v, unnest(string_split_regex({x}, {_quoted(p)})[1 : len(regexp_extract_all({x}, {_quoted(p)}, 0))]) AS g,
        generate_subscripts(regexp_extract_all({x}, {_quoted(p)}, 0), 1) AS k FROM t"""
        for k, o, x, p, group, least in kinds
    )
    bound = " ".join(f"WHEN regexp_matches(m, {_quoted(p)}) THEN {most_weight(WINDOW, bits)}" for p, bits in CLASSES)
    allowed = " OR ".join(f"regexp_matches(m, {_quoted(p)})" for p in ALLOWED)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, {blank} AS blank FROM documents),
found AS ({found}),
placed AS (SELECT *, (sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM found
    WINDOW w AS (PARTITION BY doc_id, o ORDER BY k)),
candidates AS (SELECT doc_id, s, m, CASE {bound} END AS most FROM placed WHERE kind = 'entropy' AND NOT ({allowed})),
windows AS (SELECT doc_id, s, most, unnest(range(0, length(m) - {WINDOW - 1})) AS i, m FROM candidates),
weighed AS (SELECT doc_id, s, i, most, substring(m, (i + 1)::BIGINT, {WINDOW}) AS c, list_sum(list_transform(list_distinct(string_split(c, '')), lambda ch:
    round((length(c) - length(replace(c, ch, ''))) * log2(length(c) - length(replace(c, ch, ''))) * {SCALE})::BIGINT)) AS z FROM windows),
spans AS (SELECT doc_id, o, kind, s, s + length(m) AS e FROM placed WHERE kind <> 'entropy' AND length(v) >= least
    UNION ALL SELECT doc_id, {len(BASE)}, 'entropy', s + min(i), s + max(i) + {WINDOW} FROM weighed WHERE z <= most GROUP BY doc_id, s),
joined AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) FILTER (o < {len(BASE)}) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) AS spans
    FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN joined USING (doc_id)"""


@cat.query("op9_entropy_secrets", _secrets_sql())
def entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir))


@cat.query(
    "op8_ball_tree_search",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
)
def ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


@cat.query(
    "op11_lemp_hard_negatives",
    """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a JOIN v c ON c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
)
def lemp_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label)


def _clusters_sql() -> str:
    """The rounds one after the other; a distance is x.x - 2 x.c + c.c."""
    steps = []
    for turn in range(ROUNDS + 1):
        steps.append(f"""a{turn} AS MATERIALIZED (SELECT row, min({{'d': xx - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e), 'k': k}}) AS z
  FROM v, c{turn} c GROUP BY row)""")
        if turn < ROUNDS:
            steps.append(f"""m{turn} AS (SELECT k, i, floor(sum(x) / count(*)) AS m FROM (SELECT z.k AS k, unnest(e) AS x, generate_subscripts(e, 1) AS i
  FROM a{turn} JOIN v USING (row)) GROUP BY k, i),
c{turn + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.e, c.e) AS e FROM c{turn} c LEFT JOIN (SELECT k, list(m ORDER BY i) AS e FROM m{turn} GROUP BY k) n USING (k))""")
    return f"""
WITH v AS MATERIALIZED (SELECT *, list_inner_product(e, e) AS xx, row_number() OVER () AS row FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, e FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, e FROM v ORDER BY h, e LIMIT {CLUSTERS})),
{', '.join(steps)}
SELECT vec_id, z.k::INT AS cluster, z.d::BIGINT AS distance, (sum(z.d) OVER (PARTITION BY z.k))::BIGINT AS cluster_inertia, (sum(z.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.e, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (row) JOIN c{ROUNDS} c ON c.k = z.k"""


@cat.query("op12_va_file_clusters", _clusters_sql())
def va_file_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


@cat.query(
    "op13_difference_cover_dedup",
    """
WITH t AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT row, c, substr(h, (2 * c + 1)::BIGINT, 598) AS p FROM (SELECT row, h, unnest(range(0, length(h) // 2 - 199, 100)) AS c FROM t)),
w AS (SELECT row, c, p, unnest(range(0, length(p) // 2 - 199)) AS o FROM c),
k AS (SELECT row, c + o AS s, count(*) OVER (PARTITION BY md5(substr(p, (2 * o + 1)::BIGINT, 400))) AS n FROM w),
r AS (SELECT row, s, s > 200 + lag(s, 1, -1000) OVER (PARTITION BY row ORDER BY s) AS fresh FROM k WHERE n > 1),
g AS (SELECT row, s, sum(fresh::INT) OVER (PARTITION BY row ORDER BY s) AS g FROM r),
runs AS (SELECT row, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY row, g),
gone AS (SELECT row, sum(b - a) AS removed, count(*) AS spans, list({'a': a, 'b': b} ORDER BY a) AS cut FROM runs GROUP BY row)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN cut IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(cut) + 1), lambda i:
    substr(h, 2 * CASE WHEN i = 0 THEN 0 ELSE cut[i].b END + 1, 2 * (CASE WHEN i = len(cut) THEN length(h) // 2 ELSE cut[i + 1].a END - CASE WHEN i = 0 THEN 0 ELSE cut[i].b END))), '') END)) AS kept_sha256
FROM t LEFT JOIN gone USING (row)""",
)
def difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir)).drop("removed")


@cat.query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run  # it imports this module

    return run(spark, sf_dir)
