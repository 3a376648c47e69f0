"""Words, target tokens, labels and leak-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagledger.functions import text as tx
from lagledger.functions.numeric import r6
from lagledger.operators import agreement as ag
from lagledger.operators import audit
from lagledger.operators import ledger as lg
from lagledger.operators import ranking as rk
from lagledger.operators import tokens as tk
from lagledger.operators.scan import scan
from lagledger.plans.catalogue import Catalogue
from lagledger.plans.standins import E_SQL, Slicing, stream, table
from lagledger.session import spread

cat = Catalogue()
TURNS = Slicing(width=1_000)


def turns(spark, folder):
    return table(spark, folder, "conversations")


@cat.query(
    "s3_explode_words",
    r"""WITH s AS (SELECT conv_id * 1000 + turn AS source, unnest(string_split(text, chr(10))) AS seg, unnest(range(len(string_split(text, chr(10))))) AS segment_pos FROM conversations),
w AS (SELECT source, segment_pos, unnest(string_split(seg, ' ')) AS word, unnest(range(len(string_split(seg, ' ')))) AS word_pos FROM s)
SELECT source, segment_pos::INTEGER AS segment_pos, word_pos::INTEGER AS word_pos, word, round(word_pos * 0.4::DOUBLE, 6) AS start FROM w""",
)
def words_of_turns(spark, folder):
    word = lambda w, i: F.struct(
        w.alias("word"), (i * F.lit(0.4)).alias("start"), (i * F.lit(0.4) + 0.3).alias("end"),
        F.lit(0.9).alias("probability"), F.lit(None).cast("string").alias("reading"),
    )
    seg = lambda s, i: F.struct(
        i.alias("id"), F.lit(0.1).alias("no_speech_prob"), F.transform(F.split(s, " "), word).alias("words")
    )
    nested = turns(spark, folder).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("source"), F.transform(F.split("text", "\n"), seg).alias("segments")
    )
    return tk.explode_words(nested, "source").select("source", "segment_pos", "word_pos", "word", r6("start").alias("start"))


@cat.query(
    "w7_neighbour_windows",
    """WITH t AS (SELECT conv_id, turn, turn * 10.0::DOUBLE AS s, turn * 10.0::DOUBLE + CASE WHEN length(text) % 7 = 0 THEN 0 ELSE length(text) / 100 END AS f FROM conversations),
n AS (SELECT *, lag(s) OVER w AS ps, lag(f) OVER w AS pf, lead(s) OVER w AS ns, lead(f) OVER w AS nf FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN pf > ps THEN round(pf, 6) END AS previous_end, CASE WHEN nf > ns THEN round(ns, 6) END AS next_start FROM n""",
)
def neighbours(spark, folder):
    start = F.col("turn") * F.lit(10.0)
    size = F.length("text")
    t = turns(spark, folder).select(
        "conv_id", "turn", start.alias("s"), (start + F.when(size % 7 == 0, 0.0).otherwise(size / 100)).alias("f")
    )
    n = tk.neighbour_windows(t, ["conv_id"], "turn", "s", "f", TURNS)
    return n.select(
        "conv_id", "turn", r6("previous_window.end_s").alias("previous_end"), r6("next_window.start_s").alias("next_start")
    )


# Words of documents: half a second each, Latin p and b as target letters.
WORDS_SQL = r"""w AS (SELECT doc_id, lang, source, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word, unnest(range(len(string_split(replace(text, chr(10), ' '), ' ')))) AS pos FROM documents)"""


def doc_words(spark, folder):
    d = spread(table(spark, folder, "documents"))
    return d.select(
        "doc_id", "lang", "source", F.posexplode(F.split(F.translate("text", "\n", " "), " ")).alias("pos", "word")
    ).select("doc_id", "lang", "source", F.col("pos").cast("long").alias("pos"), "word")


IGN = r"[ \t\r\n、。,.!?！？「」『』（）()\[\]【】]"
CHARS_SQL = rf"""{WORDS_SQL}, pb AS (SELECT * FROM w WHERE regexp_matches(word, '[pb]')),
ch AS (SELECT doc_id, pos, word, unnest(string_split(word, '')) AS c, unnest(range(len(string_split(word, '')))) AS i FROM pb),
rk AS (SELECT *, count(*) FILTER (NOT regexp_matches(c, '{IGN}')) OVER (PARTITION BY doc_id, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r,
 count(*) FILTER (NOT regexp_matches(c, '{IGN}')) OVER (PARTITION BY doc_id, pos) AS n FROM ch),
oc AS (SELECT doc_id, pos, word, c AS letter, i, row_number() OVER (PARTITION BY doc_id, pos ORDER BY i) - 1 AS occurrence_index,
 pos * 0.5::DOUBLE + 0.4::DOUBLE * (r + 0.5::DOUBLE) / n AS anchor FROM rk WHERE c IN ('p', 'b'))"""


def doc_occurrences(spark, folder):
    w = doc_words(spark, folder).withColumn("s", F.col("pos") * F.lit(0.5)).withColumn("e", F.col("s") + 0.4)
    return tk.occurrences(w, "word", "s", "e", "pb")


@cat.query(
    "w8_occurrences",
    f"WITH {CHARS_SQL} SELECT doc_id, pos, occurrence_index::INTEGER AS occurrence_index, letter FROM oc",
)
def occurrences(spark, folder):
    return doc_occurrences(spark, folder).select("doc_id", "pos", "occurrence_index", "letter")


@cat.query("f5_proportional_anchor", f"WITH {CHARS_SQL} SELECT doc_id, pos, i::INTEGER AS at, round(anchor, 6) AS anchor FROM oc")
def anchors(spark, folder):
    return doc_occurrences(spark, folder).select("doc_id", "pos", F.col("character_index").alias("at"), r6("anchor_s").alias("anchor"))


@cat.query(
    "f4_target_class",
    f"WITH {CHARS_SQL} SELECT doc_id, letter AS phoneme_class, count(*) AS tokens FROM oc GROUP BY ALL",
)
def letter_class(spark, folder):
    o = doc_occurrences(spark, folder).withColumn("phoneme_class", tx.target_class("letter", "p", "b"))
    return o.groupBy("doc_id", "phoneme_class").agg(F.count(F.lit(1)).alias("tokens"))


@cat.query("f3_nfkc")
def normalized(spark, folder):
    d = spread(table(spark, folder, "documents"))
    return d.select("doc_id", tx.nfkc("text").alias("n")).select("doc_id", F.length("n").alias("n_chars"), F.sha2("n", 256).alias("sha"))


@cat.query(
    "c3_target_tokens",
    f"""WITH {CHARS_SQL}, t AS (SELECT oc.*, 0.5 + (length(word) % 6) / 10 AS prob, d.n_words * 0.5::DOUBLE AS total FROM oc JOIN (SELECT doc_id, count(*) AS n_words FROM w GROUP BY 1) d USING (doc_id)),
iv AS (SELECT *, floor(anchor / 60)::BIGINT AS iv, anchor - floor(anchor / 60) * 60 AS off FROM t)
SELECT doc_id, pos, occurrence_index::INTEGER AS occurrence_index, letter AS phoneme_class, CASE WHEN off < 50 THEN iv END AS interval_id,
 concat_ws(',', CASE WHEN anchor >= 900 THEN 'after_interview_cutoff' END, CASE WHEN prob < 0.75 THEN 'low_asr_probability' END, CASE WHEN off >= 50 THEN 'outside_labeled_speaker_interval'
 WHEN off < 0.75 OR off >= 49.25 THEN 'near_active_speaker_transition' END) AS reasons FROM iv""",
)
def target_tokens(spark, folder):
    w = doc_words(spark, folder).select(
        "doc_id", "pos", "word", F.lit(None).cast("string").alias("reading"), (F.col("pos") * F.lit(0.5)).alias("start"),
        (F.col("pos") * F.lit(0.5) + 0.4).alias("end"), (0.5 + (F.length("word") % 6) / 10).alias("probability"),
        F.lit(None).cast("double").alias("no_speech_prob"),
    )
    # Label intervals: the first 50 seconds of every minute of a document.
    d = table(spark, folder, "documents")
    minutes = F.size(F.split(F.translate("text", "\n", " "), " ")) * 0.5 / 60
    iv = d.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(minutes))).alias("interval_id")).select(
        "doc_id", "interval_id", (F.col("interval_id") * 60.0).alias("start_s"), (F.col("interval_id") * 60.0 + 50.0).alias("end_s")
    )
    t = tk.target_tokens(w, iv, ["doc_id"], "pos", Slicing(width=10_000), cutoff=900.0, p_letters="p", b_letters="b", interval_width=3600.0)
    return t.select(
        "doc_id", "pos", "occurrence_index", "phoneme_class", F.col("interval.interval_id").alias("interval_id"),
        F.concat_ws(",", "exclusion_reasons").alias("reasons"),
    )


@cat.query(
    "c3_token_ids",
    f"WITH {CHARS_SQL}, n AS (SELECT doc_id, pos, occurrence_index, row_number() OVER (ORDER BY doc_id, pos, occurrence_index) AS k FROM oc) SELECT doc_id, pos, occurrence_index::INTEGER AS occurrence_index, 'pb-' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS token_id FROM n",
)
def token_ids(spark, folder):
    o = doc_occurrences(spark, folder).select("doc_id", "pos", "occurrence_index")
    # One slice per thousand documents; a crowded slice is cut at its quantiles.
    return tk.number_tokens(o, "doc_id", Slicing(width=1_000), ["pos", "occurrence_index"])


@cat.query(
    "a15_reading_audit",
    f"""WITH {WORDS_SQL}, m AS (SELECT source, doc_id, pos, word, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS rn FROM w WHERE lang <> 'en'),
x AS (SELECT source, string_agg(word, '|' ORDER BY doc_id, pos) AS ex FROM m WHERE rn <= 20 GROUP BY 1)
SELECT source, count(*) AS word_count, count(*) FILTER (lang = 'en') AS with_reading, count(*) FILTER (lang <> 'en') AS missing_reading, any_value(ex) AS examples FROM w LEFT JOIN x USING (source) GROUP BY 1""",
)
def readings(spark, folder):
    w = doc_words(spark, folder).select(
        "source", "word", "doc_id", "pos",
        F.when(F.col("lang") == "en", "r").alias("reading"),
    )
    a = tk.reading_audit(w, ["source"], "word", "reading", "doc_id", 20, ties=["pos"])
    return a.select("source", "word_count", "with_reading", "missing_reading", F.concat_ws("|", "missing_examples").alias("examples"))


@cat.query(
    "f7_dice",
    r"""WITH d AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents), n AS (SELECT a.doc_id, a.w AS a, b.w AS b FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(2 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS dice FROM n""",
)
def dice(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("a"))
    n = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b")), "doc_id")
    return n.select("doc_id", r6(tx.dice("a", "b")).alias("dice"))


GRAM_SQL = lambda name, ident, src: rf"""{name}w AS (SELECT {ident}, unnest(string_split(replace(lower(text), chr(10), ' '), ' ')) AS g, unnest(range(len(string_split(replace(lower(text), chr(10), ' '), ' ')))) AS i FROM {src}),
{name}t AS (SELECT {ident}, g || ' ' || lead(g) OVER o || ' ' || lead(g, 2) OVER o AS g FROM {name}w WINDOW o AS (PARTITION BY {ident} ORDER BY i)),
{name} AS (SELECT DISTINCT {ident}, g FROM {name}t WHERE g IS NOT NULL), {name}n AS (SELECT {ident}, count(*) AS n FROM {name} GROUP BY 1)"""


def word_triples(df, ident):
    w = F.split(F.translate(F.lower("text"), "\n", " "), " ")
    # Shifted copies side by side: the text is split a fixed number of times per row.
    shift = lambda k: F.slice("_w", k, F.greatest(F.size("_w") - 2, F.lit(0))).alias(f"g{k}")
    zipped = F.arrays_zip(shift(1), shift(2), shift(3))
    return df.select(ident, w.alias("_w")).select(ident, F.transform(zipped, lambda z: F.concat_ws(" ", z["g1"], z["g2"], z["g3"])).alias("shingles"))


@cat.query(
    "c4_template_match",
    f"""WITH {GRAM_SQL('ga', 'doc_id', 'documents')}, {GRAM_SQL('gb', 'item_id', 'benchmark')},
c AS (SELECT doc_id, item_id, 2 * count(*) / (any_value(gan.n) + any_value(gbn.n)) AS s FROM ga JOIN gb USING (g) JOIN gan USING (doc_id) JOIN gbn USING (item_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id) AS rn FROM c), k AS (SELECT doc_id, max(CASE WHEN rn = 1 THEN item_id END) AS best, max(CASE WHEN rn = 1 THEN s END) AS s1, coalesce(max(CASE WHEN rn = 2 THEN s END), 0) AS s2 FROM r GROUP BY 1)
SELECT doc_id, round(s1, 6) AS best_score, round(s1 - s2, 6) AS margin, CASE WHEN s1 >= 0.05 AND s1 - s2 >= 0.02 THEN best::VARCHAR ELSE 'unknown' END AS label FROM documents LEFT JOIN k USING (doc_id)""",
)
def templates(spark, folder):
    items = word_triples(spread(table(spark, folder, "documents")), "doc_id")
    known = word_triples(table(spark, folder, "benchmark"), "item_id")
    m = tk.template_match(items, known, "doc_id", "item_id", "shingles", minimum=0.05, margin=0.02)
    return m.select("doc_id", r6("best_score").alias("best_score"), r6("margin").alias("margin"), "label")


@cat.query(
    "t2_best_and_margin",
    f"""WITH e AS ({E_SQL}), s AS (SELECT user_id, event_type, avg(value) / 100 AS s FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type) AS rn FROM s),
k AS (SELECT user_id, max(CASE WHEN rn = 1 THEN event_type END) AS b, max(CASE WHEN rn = 1 THEN s END) AS s1, coalesce(max(CASE WHEN rn = 2 THEN s END), 0) AS s2 FROM r GROUP BY 1)
SELECT user_id, round(s1, 6) AS best_score, round(s1 - s2, 6) AS margin, CASE WHEN s1 >= 0.55 AND s1 - s2 >= 0.12 THEN b ELSE 'unknown' END AS label FROM k""",
)
def margins(spark, folder):
    s = stream(spark, folder).groupBy("user_id", "event_type").agg((F.avg("value") / 100).alias("s"))
    b = rk.best_and_margin(s, "user_id", "event_type", "s")
    return b.select("user_id", r6("best_score").alias("best_score"), r6("margin").alias("margin"), "label")


@cat.query(
    "a11_plurality",
    """WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS m FROM c)
SELECT conv_id, CASE WHEN count(*) = 1 THEN any_value(role) ELSE 'unknown' END AS label FROM m WHERE n = m GROUP BY 1""",
)
def plurality(spark, folder):
    return ag.plurality(turns(spark, folder), "conv_id", "role", unknown="system").select(
        "conv_id", F.when(F.col("label") == "system", "unknown").otherwise(F.col("label")).alias("label")
    )


@cat.query(
    "p15_stable_label",
    """WITH c AS (SELECT conv_id, min(CASE WHEN turn % 2 = 0 THEN role END) AS lo, max(CASE WHEN turn % 2 = 0 THEN role END) AS hi, count(*) FILTER (turn % 2 = 1) AS g, min(CASE WHEN turn % 2 = 1 THEN role END) AS glo, max(CASE WHEN turn % 2 = 1 THEN role END) AS ghi
 FROM (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'user' ELSE role END AS role FROM conversations) GROUP BY 1)
SELECT conv_id, CASE WHEN lo = hi THEN lo ELSE 'unknown' END AS label, coalesce(lo = hi AND g > 0 AND glo = lo AND ghi = lo, false) AS stable FROM c""",
)
def stable(spark, folder):
    v = turns(spark, folder).select(
        "conv_id", F.when(F.col("conv_id") % 3 == 0, "user").otherwise(F.col("role")).alias("role"), (F.col("turn") % 2 == 1).alias("guard")
    )
    return tk.stable_label(v, "conv_id", "role", "guard")


@cat.query(
    "w6_compress_intervals",
    """WITH t AS (SELECT conv_id, turn, role, length(text) AS n, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS s FROM conversations),
r AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t), g AS (SELECT conv_id, k, role, min(turn) AS f, count(*) AS sample_count, median(n) AS med, min(n % 50) AS mm FROM r GROUP BY ALL),
x AS (SELECT *, lead(f) OVER (PARTITION BY conv_id ORDER BY k) AS nf FROM g)
SELECT conv_id, k::BIGINT AS interval_index, role, sample_count, round(med, 6) AS median_score, mm::INTEGER AS minimum_margin, CASE WHEN k = 1 THEN 0.0::DOUBLE ELSE f - 0.5::DOUBLE END AS start, CASE WHEN nf IS NULL THEN 100.0::DOUBLE ELSE nf - 0.5::DOUBLE END AS "end" FROM x""",
)
def intervals(spark, folder):
    t = turns(spark, folder).select("conv_id", "turn", "role", F.length("text").alias("n"), (F.length("text") % 50).alias("m"))
    i = tk.compress_intervals(
        t, ["conv_id"], "turn", "role", TURNS, half_step=0.5, start=F.lit(0.0), end=F.lit(100.0), score="n", margin="m"
    )
    return i.select("conv_id", "interval_index", "role", "sample_count", r6("median_score").alias("median_score"), F.col("minimum_margin").alias("minimum_margin"), "start", "end")


@cat.query(
    "j2_token_join",
    """WITH t AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS k FROM conversations),
m AS (SELECT conv_id, turn, role, k, CASE WHEN n % 5 <> 0 THEN 'm' || (n % 3) END AS label FROM t WHERE n % 4 <> 1)
SELECT t.conv_id, t.turn, coalesce(m.label, 'interval') AS label, CASE WHEN m.label IS NOT NULL THEN 'manifest' ELSE 'interval' END AS label_source, CASE WHEN m.k IS NULL THEN 'missing_from_manifest' ELSE '' END AS reasons
FROM t LEFT JOIN m USING (conv_id, turn, role, k)""",
)
def token_join(spark, folder):
    t = scan(
        turns(spark, folder).select("conv_id", "turn", "role", F.length("text").alias("n")), ["conv_id", "role"], "turn", TURNS, index="k"
    )
    n = F.col("n")
    manifest = t.filter(n % 4 != 1).select(
        "conv_id", "turn", "role", "k", F.when(n % 5 != 0, F.concat(F.lit("m"), (n % 3).cast("string"))).alias("label")
    )
    out = lg.token_join(t.withColumn("label", F.lit("interval")), manifest, ["conv_id", "turn", "role", "k"], "label")
    return out.select("conv_id", "turn", "label", "label_source", F.concat_ws(",", "manifest_reasons").alias("reasons"))


@cat.query(
    "j2_unused_manifest",
    """WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations) SELECT conv_id, turn + CASE WHEN n % 3 = 0 THEN 1000 ELSE 0 END AS turn, role FROM t
WHERE n % 3 = 0 OR n % 2 = 0""",
)
def unused(spark, folder):
    """A manifest of all turns, a third of them shifted, against the turns of odd length."""
    t, n = turns(spark, folder).select("conv_id", "turn", "role", F.length("text").alias("n")), F.col("n")
    manifest = t.select("conv_id", (F.col("turn") + F.when(n % 3 == 0, 1000).otherwise(0)).alias("turn"), "role")
    return lg.unused_manifest(t.filter(n % 2 == 1), manifest, ["conv_id", "turn", "role"])


@cat.query(
    "j18_resolve_group",
    """WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN 'candidate' END AS own, CASE WHEN turn % 2 = 0 THEN 'control' END AS iv FROM conversations), c AS (SELECT * FROM (VALUES ('user', 'candidate'), ('assistant', 'control')) v(role, cg))
SELECT conv_id, turn, coalesce(own, cg, iv) AS resolved_group, CASE WHEN own IS NOT NULL THEN 'row' WHEN cg IS NOT NULL THEN 'configuration' WHEN iv IS NOT NULL THEN 'interval' ELSE 'none' END AS group_source,
 CASE WHEN own <> cg THEN 'group_mismatch' ELSE '' END AS reasons FROM t LEFT JOIN c USING (role)""",
)
def resolved(spark, folder):
    t = turns(spark, folder).select(
        "conv_id", "turn", "role", F.when(F.col("turn") % 3 == 0, "candidate").alias("own"), F.when(F.col("turn") % 2 == 0, "control").alias("iv")
    )
    config = spark.createDataFrame([("user", "candidate"), ("assistant", "control")], "role string, config_group string")
    out = lg.resolve_group(t, config, "role", "own", "iv")
    return out.select("conv_id", "turn", "resolved_group", "group_source", F.concat_ws(",", "group_reasons").alias("reasons"))


@cat.query(
    "a24_manifest_summary",
    """WITH t AS (SELECT CASE WHEN role = 'system' THEN 'unknown' ELSE role END AS role, turn % 2 = 0 AS stable FROM conversations)
SELECT 'unknown_fraction' AS item, 'all' AS name, round(avg((role = 'unknown')::INT), 6) AS value FROM t UNION ALL SELECT 'tokens', role, count(*)::DOUBLE FROM t GROUP BY role
UNION ALL SELECT 'stable_tokens', 'all', (count(*) FILTER (stable))::DOUBLE FROM t""",
)
def summary(spark, folder):
    t = turns(spark, folder).select(
        F.when(F.col("role") == "system", "unknown").otherwise(F.col("role")).alias("role"), (F.col("turn") % 2 == 0).alias("stable")
    )
    return tk.manifest_summary(t, t, "role").select("item", "name", r6("value").alias("value"))


# RE2 has no look-behind and spells the case flag the same way.
RE2 = dict(audit.TEXT_PATTERNS)
RE2["Japanese mobile number"] = r"(?:^|[^0-9])0[789]0(?:[- ]?[0-9]{4}){2}(?:[^0-9]|$)"
LEAK_SQL = lambda ident, text, src: " UNION ALL ".join(
    "SELECT {i}, '{n}' AS pattern FROM {s} WHERE regexp_matches({t}, '{p}')".format(i=ident, n=n, s=src, t=text, p=p.replace("'", "''"))
    for n, p in RE2.items()
)


@cat.query("c1_leak_scan_documents", LEAK_SQL("doc_id", "text", "documents"))
def leaks(spark, folder):
    return audit.leak_scan(spread(table(spark, folder, "documents")), "doc_id", "text")


@cat.query("c1_leak_scan_pages", LEAK_SQL("page_id", "html", "pages"))
def page_leaks(spark, folder):
    return audit.leak_scan(spread(table(spark, folder, "pages")), "page_id", "html")


def page_files(spark, folder):
    """Pages as a file table: path from the URL, mode, size and bytes."""
    p = table(spark, folder, "pages")
    i = F.col("page_id")
    stem = F.regexp_replace("url", "^https?://|[?#].*$", "")
    path = (
        F.when(i % 11 == 0, F.concat(F.lit("/"), stem)).when(i % 11 == 1, F.concat(F.lit("Private/"), stem))
        .when(i % 11 == 2, F.concat(stem, F.lit("/a.PNG"))).when(i % 11 == 3, F.concat(stem, F.lit("/.env.local"))).otherwise(stem)
    )
    mode = F.when(i % 13 == 0, "120000").when(i % 13 == 1, "040000").otherwise("100644")
    size = F.length("html") * F.when(i % 7 == 0, 1000).otherwise(1)
    return p.select("page_id", path.alias("path"), mode.alias("mode"), size.cast("long").alias("size"), F.col("html").cast("binary").alias("content"))


FILES_SQL = r"""f AS (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS stem, html, page_id AS i FROM pages),
q AS (SELECT page_id, CASE i % 11 WHEN 0 THEN '/' || stem WHEN 1 THEN 'Private/' || stem WHEN 2 THEN stem || '/a.PNG' WHEN 3 THEN stem || '/.env.local' ELSE stem END AS path,
 CASE i % 13 WHEN 0 THEN '120000' WHEN 1 THEN '040000' ELSE '100644' END AS mode, length(html) * CASE WHEN i % 7 = 0 THEN 1000 ELSE 1 END AS size, html FROM f)"""


@cat.query(
    "c2_path_rules",
    rf"""WITH {FILES_SQL} SELECT page_id, CASE WHEN path LIKE '/%' THEN 'unsafe path' WHEN mode = '120000' THEN 'symlink' WHEN mode = '040000' THEN 'unsupported file mode'
 ELSE concat_ws(',', CASE WHEN path LIKE '%/.env%' THEN 'forbidden filename' END, CASE WHEN lower(path) LIKE 'private/%' THEN 'private or generated directory' END,
 CASE WHEN size > 5242880 THEN 'file larger than 5 MiB' END, CASE WHEN path LIKE '%/a.PNG' THEN 'forbidden file type' END) END AS findings FROM q""",
)
def file_rules(spark, folder):
    return audit.path_findings(page_files(spark, folder)).select("page_id", F.concat_ws(",", "findings").alias("findings"))


# Pages as media: a third has an MP4 head, a third a PNG head of 64 x 48, with wrong heads here and there.
MEDIA_SQL = rf"""{FILES_SQL}, b AS (SELECT page_id, lpad(page_id::VARCHAR, 9, '0') || '/' || path AS path, mode, hex(encode(html)) AS h, page_id AS i FROM q),
c AS (SELECT *, CASE i % 3 WHEN 0 THEN CASE WHEN i % 7 = 0 THEN '66747970' || '0000' ELSE '0000002066747970' END WHEN 1 THEN CASE WHEN i % 7 = 0 THEN '89504E470D0A1A0B' ELSE '89504E470D0A1A0A' END || '0000000D49484452' || '00000040' || '00000030' ELSE '' END || h AS x FROM b),
m AS (SELECT *, CASE WHEN i % 5 = 0 THEN length(x) // 2 * 1000 ELSE length(x) // 2 END AS size, sha256(unhex(x)) AS sha FROM c)"""


def media_files(spark, folder):
    i = F.col("page_id")
    head = (
        F.when(i % 3 == 0, F.when(i % 7 == 0, "667479700000").otherwise("0000002066747970"))
        .when(i % 3 == 1, F.concat(F.when(i % 7 == 0, "89504E470D0A1A0B").otherwise("89504E470D0A1A0A"), F.lit("0000000D49484452" + "00000040" + "00000030"))).otherwise("")
    )
    f = page_files(spark, folder).withColumns({"path": F.concat(F.lpad(i.cast("string"), 9, "0"), F.lit("/"), "path"), "content": F.unhex(F.concat(head, F.hex("content")))})
    return f.withColumn("size", (F.octet_length("content") * F.when(i % 5 == 0, 1000).otherwise(1)).cast("long"))


@cat.query(
    "j15_allowlist",
    rf"""WITH {MEDIA_SQL}, a AS (SELECT *, i % 2 = 0 AND i % 3 < 2 AS k, i % 2 = 0 AND i % 3 = 0 AS v, i % 2 = 0 AND i % 3 = 1 AS p, CASE WHEN i % 4 = 0 THEN sha256('x') ELSE sha END AS want FROM m)
SELECT page_id, concat_ws(',', CASE WHEN NOT k AND path LIKE '%/a.PNG' THEN 'media not on the list' END, CASE WHEN NOT v AND size > 5242880 THEN 'file too large' END,
 CASE WHEN k AND mode <> '100644' THEN 'mode differs' END, CASE WHEN v AND i % 5 = 0 THEN 'size differs' END, CASE WHEN k AND sha <> want THEN 'hash differs' END,
 CASE WHEN (v OR p) AND i % 7 = 0 THEN 'unexpected file type' END, CASE WHEN p AND i % 7 <> 0 AND i % 8 = 0 THEN 'dimensions differ' END) AS reasons FROM a""",
)
def allowed(spark, folder):
    f, i = media_files(spark, folder), F.col("page_id")
    a = f.filter((i % 2 == 0) & (i % 3 < 2)).select(
        "path", F.when(i % 3 == 0, "mp4").otherwise("png").alias("kind"), F.lit("100644").alias("mode"), F.octet_length("content").cast("long").alias("size"),
        F.when(i % 4 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"), F.when(i % 8 == 0, 65).otherwise(64).alias("width"), F.lit(48).alias("height"),
    )
    return audit.allowlist(f, a).select("page_id", F.concat_ws(",", "allow_reasons").alias("reasons"))


DEEP = 12


@cat.query(
    "x7_forbidden_keys",
    f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a.b[1].Overall-Score' WHEN 2 THEN 'voiceprint' WHEN 3 THEN '{"deep." * DEEP}closest_speaker' ELSE 'x.my_speaker_similarity_2' END AS path, 'forbidden_key' AS problem
FROM events WHERE event_id % 5 <> 1 UNION ALL SELECT event_id, 'distance', 'forbidden_key' FROM events WHERE event_id % 5 = 4""",
)
def forbidden(spark, folder):
    """Real properties with forbidden names at the top, in a list, as a part of a name and below twelve levels."""
    e, m = table(spark, folder, "events"), F.col("event_id") % 5
    inner = F.regexp_replace("props", "^.|.$", "")
    put = lambda head: F.concat(F.lit("{" + head + ", "), inner, F.lit("}"))
    raw = (
        F.when(m == 0, put('"a": {"b": [1, {"Overall-Score": 2}]}')).when(m == 1, F.col("props")).when(m == 2, put('"voiceprint": {"z": [[1]]}'))
        .when(m == 3, put('"deep": {' * DEEP + '"closest_speaker": 1' + "}" * DEEP)).otherwise(put('"x": {"my_speaker_similarity_2": 0}, "distance": 3'))
    )
    return audit.forbidden_keys(e.select("event_id", raw.alias("raw")), "event_id", "raw")


@cat.query(
    "x8_boundary_false",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'boundary:voiceprints_used' WHEN 2 THEN 'boundary:identity_used,boundary:voiceprints_used' ELSE 'boundary_missing' END AS reasons FROM events""",
)
def boundary(spark, folder):
    e = table(spark, folder, "events").select("event_id")
    m = F.col("event_id") % 4
    raw = (
        F.when(m == 0, '{"identity_used": false, "voiceprints_used": false}').when(m == 1, '{"identity_used": false, "voiceprints_used": 0}')
        .when(m == 2, '{"identity_used": true, "voiceprints_used": "false"}').otherwise("[]")
    )
    out = audit.boundary_flags(e.withColumn("raw", raw), "raw", ["identity_used", "voiceprints_used"])
    return out.select("event_id", F.concat_ws(",", "boundary_reasons").alias("reasons"))


@cat.query(
    "x9_verify_artifacts",
    """WITH m AS (SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 10 = 0 THEN 'zz' WHEN doc_id % 10 = 1 THEN sha256('x') ELSE upper(sha256(text)) END AS h, doc_id FROM documents), f AS (SELECT 'd' || doc_id AS name, sha256(text) AS a FROM documents WHERE doc_id % 10 <> 2)
SELECT name, concat_ws(',', CASE WHEN h = 'zz' THEN 'malformed hash' END, CASE WHEN a IS NULL THEN 'file missing' END, CASE WHEN a <> lower(h) THEN 'hash differs' END) AS problems FROM m LEFT JOIN f USING (name)
WHERE h = 'zz' OR a IS NULL OR a <> lower(h) UNION ALL SELECT 'summary.json', 'required name not listed'""",
)
def artifacts(spark, folder):
    d = table(spark, folder, "documents")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name")
    m = F.col("doc_id") % 10
    sha = F.sha2("text", 256)
    manifest = d.select(name, F.when(m == 0, "zz").when(m == 1, F.sha2(F.lit("x"), 256)).otherwise(F.upper(sha)).alias("sha256"))
    files = d.filter(m != 2).select(name, sha.alias("sha256"))
    return audit.artifact_problems(manifest, files, ["d1", "summary.json"]).select("name", F.concat_ws(",", "problems").alias("problems"))


@cat.query(
    "x14_input_binding",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'legacy_missing' WHEN 1 THEN 'stale' WHEN 2 THEN 'input_missing' ELSE 'bound' END AS binding FROM documents""",
)
def bindings(spark, folder):
    d = table(spark, folder, "documents")
    m = F.col("doc_id") % 4
    sha = F.sha2("text", 256)
    ann = d.select("doc_id", F.when(m == 0, " ").when(m == 1, F.sha2(F.lit("old"), 256)).otherwise(F.upper(sha)).alias("recorded"))
    files = d.filter(m != 2).select(F.col("doc_id").alias("name"), sha.alias("sha256"))
    return audit.input_binding(ann, "recorded", files, "doc_id").select("doc_id", "binding")


@cat.query(
    "f14_canonical_sha256",
    """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"' || lang || '"' END || ',"nested":{"a":' || n_chars || ',"b":'
 || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '"' || source || '"' END || '},"source":"' || source || '"}') AS sha FROM documents""",
)
def canonical(spark, folder):
    nested = F.struct(F.when(F.col("doc_id") % 2 != 0, F.col("source")).alias("b"), F.col("n_chars").alias("a"))
    d = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), "source", nested.alias("nested"))
    return d.select("doc_id", tx.canonical_sha256(["source", "lang", "doc_id", "nested"], d.schema).alias("sha"))


@cat.query(
    "p12_include_flag",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS include FROM documents""",
)
def include(spark, folder):
    m = F.col("doc_id") % 5
    raw = F.when(m == 0, "").when(m == 1, " Yes").when(m == 2, "EXCLUDE").when(m == 3, "0").otherwise("include")
    return table(spark, folder, "documents").select("doc_id", tx.include_flag(raw).alias("include"))


@cat.query(
    "p13_normalize_category",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'reference' WHEN 2 THEN 'missing' WHEN 3 THEN 'reference' END AS category FROM documents""",
)
def category(spark, folder):
    m = F.col("doc_id") % 5
    raw = F.when(m == 0, "No-Visible Contact").when(m == 1, " strong contact").when(m == 2, "sync-absence").when(m == 3, "late_synchronized").otherwise("other")
    return table(spark, folder, "documents").select("doc_id", tx.normalize_category(raw).alias("category"))
