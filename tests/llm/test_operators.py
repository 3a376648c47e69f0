"""Each operator against brute force on one table of awkward rows, and on an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagledger.llm import exact_dedup, mixing, packing, secret_spans, substring_dedup
from lagledger.llm.ball_tree import BallTree, top_products
from lagledger.llm.components import components
from lagledger.llm.cotraining import score_quality
from lagledger.llm.exact_dedup import drop_copies, exact_groups
from lagledger.llm.interleave import interleaved_shards
from lagledger.llm.language_id import LanguageFilters, fit, identify, identify_rows, predict_language
from lagledger.llm.ngram_join import drop_near_copies, near_copies
from lagledger.llm.queries import word_tokenizer
from lagledger.llm.word_tokens import WordTokens

WORD = re.compile("[^\x20\x09-\x0d]+")


# --- exact dedup


def test_exact_groups(docs, none, plain):
    keep, size = {}, Counter(t for _, t in plain)
    for d, t in plain:
        keep[t] = max(d, keep.get(t, -1))
    want = Counter((d, keep[t], size[t], d == keep[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in plain)
    assert Counter(map(tuple, exact_groups(docs).collect())) == want
    assert exact_groups(none).count() == 0


def test_exact_groups_with_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(df).collect())
    assert got == Counter([(None, 1, 3, False), (None, 1, 3, False), (1, 1, 3, True), (None, None, 1, True)])


def test_drop_copies_keeps_one_row_of_each_text(docs, none, plain):
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t for _, t in plain})
    assert drop_copies(none).count() == 0


@pytest.mark.parametrize("sent", [exact_dedup.MOST_SENT, 0])
def test_drop_copies_of_ids_that_are_null_or_have_several_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(exact_dedup, "MOST_SENT", sent)
    rows = [(None, "a"), (1, "a"), (None, "b"), (None, "c"), (None, "c"), (2, "d"), (3, "d"), (2, "e"), (2, "e"), (2, None), (2, ""), (4, "f"), (5, "f"), (4, "g"), (5, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["text"] or "") for r in drop_copies(df).collect())
    assert got == Counter([(1, "a"), (None, "b"), (None, "c"), (3, "d"), (2, "e"), (2, ""), (5, "f"), (5, "g")])


# --- sharding


@pytest.mark.parametrize("shards", [1, 4, 100])
def test_shards_match_the_mixture(docs, none, plain, shards):
    got = interleaved_shards(docs, shards).collect()
    text = dict(plain)
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in plain)
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    total = Counter(r["source"] for r in got)
    for s in by:
        part = Counter(r["source"] for r in got if r["shard"] == s)
        assert all(abs(part[k] - n * len(by[s]) / len(got)) <= 2 for k, n in total.items())
    assert interleaved_shards(none, shards).count() == 0


# --- mixing


def test_temperature_meets_its_targets(spark):
    shares = [0.6, 0.2, 0.1, 0.06, 0.04]
    df = spark.createDataFrame([(p,) for p in shares], "__p double")

    def entropy(a):
        w = np.array(shares) ** a
        w /= w.sum()
        return -(w * np.log(w)).sum()

    a = mixing.temperature(df, 0.9, None)
    assert entropy(a) >= 0.9 * math.log(5) > entropy(a + 1 / mixing.GRID)
    a = mixing.temperature(df, None, 3.0)
    assert (0.6 / 0.04) ** (1 - a) <= 3 + 1e-9 < (0.6 / 0.04) ** (1 - a + 1 / mixing.GRID)
    assert mixing.temperature(df, 0.1, None) == 1.0
    assert mixing.temperature(df.limit(0), 0.9, 2.0) == 1.0


def test_mix_passes_each_source_once_and_small_ones_again(docs, none, plain):
    tokens = Counter()
    for d, t in plain:
        tokens[d] += len(WORD.findall(t)) + 1
    got = mixing.mix(docs, 1.0, 2.0, block_tokens=500).collect()
    assert {r["doc_id"] for r in got if r["pass"] == 0} == {d for d, _ in plain}
    total, out = Counter(), Counter()
    for r in got:
        out[r["source"]] += r["tokens"]
        total[r["source"]] += r["tokens"] * (r["pass"] == 0)
    longest = max(r["tokens"] for r in got)
    weight = {r["source"]: r["target_weight"] for r in got}
    budget = max(total[s] / weight[s] for s in total)
    for s in total:
        assert total[s] <= out[s] <= 2 * total[s] + longest
        assert -2 <= out[s] - weight[s] * budget <= longest + 2
    blocks = defaultdict(list)
    for r in got:
        blocks[r["block"]].append(r["position"])
    assert all(sorted(v) == list(range(len(v))) for v in blocks.values()) and len(blocks) > 5
    again = mixing.mixed_rows(docs, 1.0, 2.0)
    assert again.columns == docs.columns
    assert Counter(r["doc_id"] for r in again.collect()) == Counter(r["doc_id"] for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0


# --- packing


def test_word_tokens_equal_the_tokenizer(plain):
    from tokenizers import Tokenizer

    texts = [t for _, t in plain] + ["don't <|endoftext|>x I'LL 3.14 Ångström é ΣΣ İ \x1c q", "µm² ªßÿÞ"]
    plain_one = Tokenizer.from_file(word_tokenizer())
    fast = WordTokens(word_tokenizer(), None)
    for t, ids in zip(texts, fast.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain_one.encode(t, add_special_tokens=False).ids, t


def check_pieces(got, ids, window=4096):
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        covered[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["context"]))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length, context in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= context <= window
        padding += 0 if at == context else window - at
    return covered, padding


def test_pack(docs, none, plain):
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(word_tokenizer())
    ids = {d: one.encode(t, add_special_tokens=False).ids + [2] for d, t in plain}
    got = packing.pack(docs.repartition(2), word_tokenizer()).collect()
    covered, padding = check_pieces(got, ids)
    times = Counter(d for d, _ in plain)
    for d, n in times.items():
        seen = Counter()
        for start, length in covered[d]:
            seen.update(range(start, start + length))
        assert seen == Counter({k: n for k in range(len(ids[d]))})
    assert padding < 4096
    assert packing.pack(none, word_tokenizer()).count() == 0


def test_fill_leaves_no_gap_while_there_are_pieces():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 4097, 300).tolist()
    full, rest = packing.fill(sorted((n, k, 0) for k, n in enumerate(sizes)), packing.TIERS)
    assert all(sum(p[0] for p in pieces) == context for context, pieces in full)
    more, rest = packing.close(rest, packing.TIERS)
    assert sum(p[0] for p in rest) < 512
    seen = defaultdict(list)
    for _, pieces in full + more + [(0, rest)]:
        for n, k, s in pieces:
            seen[k].append((s, n))
    for k, n in enumerate(sizes):
        at = 0
        for s, m in sorted(seen[k]):
            assert s == at
            at += m
        assert at == n


# --- language


def test_language_of_awkward_texts(docs, none, plain):
    got = identify(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in plain)
    text = dict(plain)
    for r in got:
        letters = any(c.isalpha() for c in text[r["doc_id"]])
        assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert identify(none).count() == 0
    kept = identify_rows(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, t in plain if any(c.isalpha() for c in t))
    assert {r["lang_pred"] for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_with_letters_of_their_own(spark):
    words = {f"l{k:03d}": "".join(chr(0x4E00 + 40 * k + i) for i in range(40)) for k in range(70)}
    rows = [(k * 10 + j, lang, letters[j:] + letters[:j]) for k, (lang, letters) in enumerate(words.items()) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    filters = fit(df)
    assert len(filters.languages) == 70  # more than one word of bits
    got = predict_language(df, filters).join(df, "doc_id").collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def syllables(seed: int, words: int, parts: list[str]) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(parts, 3)) for _ in range(words))


KINDS = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "ei", "ung", "ber"], "cc": ["oux", "ent", "que", "ill"]}


def test_language_of_held_out_documents(spark):
    """Languages that share an alphabet: nine of ten documents that took no part in the fit are named right."""
    rows = [(300 * k + j, syllables(300 * k + j, 4 + j % 40, parts), lang) for k, (lang, parts) in enumerate(KINDS.items()) for j in range(300)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {r[0]: r[2] for r in rows}
    right = [lang[r["doc_id"]] == r["lang_pred"] for r in got if r["held_out"]]
    assert len(right) > 150 and np.mean(right) >= 0.9


def test_rows_in_no_learned_language_go(spark):
    rows = [(j, syllables(j, 20, KINDS["aa"]), "aa") for j in range(40)]
    rows += [(100, syllables(1, 30, KINDS["bb"]), None), (101, "xyz", None), (102, "12 - 34", "aa"), (103, None, None)]
    kept = {r["doc_id"] for r in identify_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == {*range(40), 101}


def test_the_fit_takes_the_smallest_draws_of_a_large_language(spark):
    """The cut before the ranking changes nothing: the same filters as from the rows with the least draws."""
    rows = [(j, f"{chr(97 + j % 26) * 3} {chr(97 + j // 26 % 26) * 4}", "aa") for j in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from lagledger.llm.common import draw

    least = df.orderBy(draw("fit", F.col("doc_id")), "doc_id").limit(20)
    one, two = fit(df, fit_rows=20), fit(least, fit_rows=20)
    assert all((one.slots[o] == two.slots[o]).all() for o in one.orders)


def test_filters_forget_no_member():
    rng = np.random.default_rng(1)
    code, lang = rng.integers(0, 1 << 63, 500).astype(np.uint64), rng.integers(0, 3, 500)
    filters = LanguageFilters.build(["a", "b", "c"], (3,), 10, {3: (lang, code)})
    from lagledger.llm.language_id import _slots

    first, second = _slots(code, 10)
    mask = filters.slots[3][0][first] & filters.slots[3][0][second]
    assert (((mask >> lang.astype(np.uint64)) & np.uint64(1)) == 1).all()


# --- near copies


def brute_components(plain, width=3, percent=90):
    sets = {}
    for d, t in plain:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        w = WORD.findall(low)
        sets[d] = {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("percent,orders", [(90, 2), (90, 3), (60, 2), (80, 1)])
def test_near_copies(docs, none, plain, percent, orders):
    want = brute_components(plain, percent=percent)
    got = near_copies(docs, percent=percent, orders=orders).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((d, *want[d]) for d, _ in plain)
    assert near_copies(none).count() == 0


def test_near_copies_of_a_family_that_no_star_joins(spark):
    """A chain: each text is close to the next one only, and a null id links nothing."""
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(12):
        words = list(base)
        for j in range(k * 4):
            words[j] = f"x{j}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(100 - k, t) for k, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    want = brute_components([(100 - k, t) for k, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_copies(df).collect()}
    assert got.pop(None) == (198, None)
    assert got == want


def near_rows() -> list[tuple]:
    """A and b are linked through m only; m and another near copy have no id. Ids 5 and 6 have two texts each."""
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join([f"x{j}" for j in range(k)] + words[k:]) for k in (0, 14, 28)]
    other, third = ([f"{c}{k}" for k in range(200)] for c in "yz")
    near = [" ".join([*w[:100], "new", *w[101:]]) for w in (other, third)]
    return [
        (8, texts[0]), (None, texts[1]), (None, " ".join(["v", *words[1:]])), (9, texts[2]), (None, "q r s t"),
        (5, " ".join(other)), (5, "a b c d e"), (6, near[0]), (6, " ".join(third)), (7, near[1]), (7, "f g h i j"), (4, None),
    ]


def test_a_null_id_that_is_a_near_copy_links_nothing(spark):
    rows = [r for r in near_rows() if r[0] in (None, 8, 9, 4)]
    got = Counter((r["doc_id"], r["component_id"]) for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(8, 8), (9, 9), (4, 4), (None, None), (None, None), (None, None)])


def test_near_copies_of_ids_with_several_texts_are_the_same_in_any_partitioning(spark):
    """5 and 6 are near copies by one text, 6 and 7 by another, so all three are one component; 4 has no words."""
    rows = [(r[0], r[1], "x") for r in near_rows()] + [(4, "p q r s t", "x"), (3, "P q R s t", "x")]
    want = Counter({(5, 5): 2, (6, 5): 2, (7, 5): 2, (8, 8): 1, (9, 9): 1, (4, 4): 1, (4, 3): 1, (3, 3): 1, (None, None): 3})
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, __row string").repartition(parts)
        assert Counter((r["doc_id"], r["component_id"]) for r in near_copies(df).collect()) == want


def test_columns_named_like_inner_ones_come_back_as_they_were(docs, spark):
    """What each operator that returns whole rows keeps does not depend on further columns."""
    names = ["__id", "__key", "__row", "__copy", "__text", "__digest", "__gone", "__draw", "__end", "__full", "__KNOWN", "given0", "a.b"]
    more = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for run in (drop_copies, drop_near_copies, identify_rows, mixing.mixed_rows):
        out = run(more)
        assert out.columns == more.columns, run
        rows = out.collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in run(docs).collect()), run
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), run


def test_drop_near_copies_of_null_ids_and_ids_with_several_texts(spark):
    rows = near_rows()
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    own = {k: r[1] or "" for k, r in enumerate(rows) if r[0] is not None}
    root = {k: c for k, (_, c) in brute_components(list(own.items())).items()}
    name = {k: (rows[k][0], hashlib.sha256(own[k].encode()).hexdigest()) for k in own}
    best = {c: min(name[k] for k in own if root[k] == c) for c in root.values()}
    want = Counter(r for k, r in enumerate(rows) if k not in own or name[k] == best[root[k]])
    assert set(rows) - set(want) == {rows[7], rows[9]}
    assert Counter(map(tuple, kept.collect())) == want


def test_drop_near_copies_keeps_the_smallest(docs, none, plain):
    want = brute_components(plain)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in want.items() if c == d}
    assert drop_near_copies(none).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 31)}, **{100 + k: 100 for k in range(1, 40)}, 201: 200}


# --- search


def test_top_products(spark):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(700, 8)), 1)  # rounding makes ties
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors)]
    rows += [(1000, None, "x"), (1050, [1.0, None], "x"), (1100, [float("nan")], "x"), (1150, [float("inf")] * 8, "x"), (1200, [], "x"), (None, [1.0], "x"), (1250, [2.0], "x"), (50, vectors[50].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    whole = {k: np.floor(256 * np.pad(v, (0, 8 - len(v)))).astype(int) for k, v, _ in rows if k is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    want = set()
    ids = [k for k, v, _ in rows if k in whole and v]
    for q in {k for k in whole if k % 50 == 0}:
        best = sorted((-int(whole[q] @ whole[c]), c) for c in ids if c != q)[:5]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    for block in (8192, 4):
        assert {tuple(r) for r in top_products(df, block=block).select("query_id", "rank", "vec_id", "score").collect()} == want
    assert top_products(df.limit(0)).count() == 0
    assert top_products(df.filter("vec_id = 50").limit(1)).count() == 0


def test_ball_tree_visits_few_leaves_where_vectors_cluster():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 4000
    x = np.round(np.repeat(centres, 50, 0) + rng.normal(size=(2000, 16)) * 20).astype(np.int64)
    tree = BallTree.build(x, np.arange(2000), 50)
    scores, found = np.full((40, 3), np.iinfo(np.int64).min), np.full((40, 3), np.iinfo(np.int64).max)
    tree.search(x[::50], np.arange(0, 2000, 50), scores, found, scores[:, -1].copy())
    product = x[::50] @ x.T
    product[np.arange(40), np.arange(0, 2000, 50)] = np.iinfo(np.int64).min
    assert (np.sort(product, 1)[:, :-4:-1] == scores).all()


# --- secrets


def brute_spans(text):
    base = {
        "assign": [(m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8],
        "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32],
    }
    spans = [(a, k, b) for k, (name, found) in enumerate(base.items()) for a, b in found]
    extra = []
    for word in secret_spans.PLACEHOLDERS:
        text = re.sub(word, " " * len(word), text, flags=re.I | re.A)
    for m in re.finditer(secret_spans.CANDIDATE, text):
        if any(re.search(p, m[0]) for p in secret_spans.ALLOWED):
            continue
        bits = next(b for p, b in secret_spans.CLASSES if re.search(p, m[0]))
        hits = []
        for i in range(len(m[0]) - 19):
            counts = Counter(m[0][i : i + 20])
            if sum(round(c * math.log2(c) * secret_spans.SCALE) for c in counts.values()) <= secret_spans.most_weight(20, bits):
                hits.append(i)
        if hits:
            extra.append((m.start() + hits[0], 3, m.start() + hits[-1] + 20))
    names = ("assign", "access", "hex", "entropy")
    listed = lambda xs: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(xs))
    return *[len(v) for v in base.values()], hashlib.sha256(listed(spans).encode()).hexdigest(), listed(spans + extra)


def test_secret_spans(docs, none, plain, spark):
    want = Counter((d, *brute_spans(t)) for d, t in plain)
    assert Counter(map(tuple, secret_spans.secret_spans(docs).collect())) == want
    assert any(w[-1].startswith("entropy") for w in want)
    assert secret_spans.secret_spans(none).count() == 0
    many = "é \U0001f600" + " token=abcdefgh1 " * 1300 + "kJ8s+Zq2/LxW91bTTyUv0aQeR7mNp3Xc" * 40
    got = secret_spans.secret_spans(spark.createDataFrame([(1, many)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, *brute_spans(many))]


def test_a_placeholder_silences_only_itself(spark):
    secret = "kJ8s+Zq2/LxW91bTTyUv0aQeR7mNp3Xc"
    texts = [f"/example/{secret}", f"{secret}=xXxX{secret}", "EXAMPLE" + secret[:15], f"placeholder-changeme-{secret[:12]}"]
    got = {r[0]: r[1] for r in secret_spans.secret_spans(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).select("doc_id", "spans").collect()}
    assert got == {k: brute_spans(x)[-1] for k, x in enumerate(texts)}
    assert [v.count("entropy") for _, v in sorted(got.items())] == [1, 2, 0, 0]


# --- substring dedup


def brute_removed(plain, width):
    seen, out = set(), {}
    words = {d: WORD.findall(t) for d, t in plain}
    for d in sorted(words):
        w, gone = words[d], set()
        for i in range(len(w) - width + 1):
            window = tuple(w[i : i + width])
            if window in seen:
                gone.update(range(i, i + width))
            seen.add(window)
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("width,gram", [(20, 8), (5, 2), (3, 3)])
def test_remove_repeats(docs, none, plain, width, gram):
    want = brute_removed(plain, width)
    got = substring_dedup.remove_repeats(docs, width, gram).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter((d, *want[d]) for d, _ in plain)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))
    assert substring_dedup.remove_repeats(none, width, gram).count() == 0


# --- quality


def test_quality_scores_all_rows(docs, none, plain, spark):
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(30)] + [(3, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    got = score_quality(docs, labels, rounds=1).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in plain)
    assert all(0 <= r[c] <= 1 for r in got for c in ("p_text", "p_meta", "score"))
    assert all(r["keep"] == (r["score"] >= 0.5) for r in got)
    assert score_quality(none, labels, rounds=1).count() == 0
    assert {r["score"] for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_on_held_out_labels(spark):
    """Junk repeats a word and has many signs; the labels of every third row are kept back."""
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for k in range(400):
        good = k % 4 != 0
        words = [f"w{int(x)}" for x in rng.integers(0, 300, 60)]
        rows.append((k, " ".join(words) if good else " ".join(w + "###" for w in words[:10] * 6), "en", f"s{k % 5}", 300))
        labels.append((k, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    truth = spark.createDataFrame(labels, "doc_id long, quality int")
    got = score_quality(docs, truth.filter("doc_id % 3 != 0")).join(truth, "doc_id").filter("doc_id % 3 = 0").collect()
    assert np.mean([r["keep"] == (r["quality"] == 1) for r in got]) > 0.95
