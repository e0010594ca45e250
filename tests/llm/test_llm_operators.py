"""Every operator's query against a brute-force version, on a corpus of awkward cases."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter

import brute
import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from routegraph.llm import exact_dedup, kn_scoring, langid, packed, secret_scan, sharding, suffix_dedup
from routegraph.llm.ngram_join import similar_texts
from routegraph.llm.queries import ORACLE_SQL, QUERIES


def rows_of(spark, name, corpus):
    return [tuple(r) for r in QUERIES[name](spark, corpus[0]).collect()]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert {"doc_id", "conv_id", "word", "page_id"} & set(df.columns) and df.collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle_sql(spark, corpus, name, tmp_path):
    con, folder = duckdb.connect(), corpus[0]
    if name == "op8_exact_dedup":  # its SQL names the row that stays by its key: unique keys
        unique = f"SELECT DISTINCT ON (doc_id) * FROM '{folder}/documents.parquet' WHERE doc_id IS NOT NULL"
        con.sql(f"COPY ({unique}) TO '{tmp_path}/documents.parquet'")
        folder = str(tmp_path)
    for t in ("documents", "benchmark", "pages", "conversations"):
        if name != "op8_exact_dedup" or t == "documents":
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df, rel = QUERIES[name](spark, folder), con.sql(ORACLE_SQL[name])
    df = df.select(*rel.columns)
    place = [list(rel.columns).index(c) for c in df.columns]
    near = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
    same([near(r) for r in df.collect()], [near(r[i] for i in place) for r in rel.fetchall()])


# ---- sharding ---------------------------------------------------------------------------


def ring_hash(key, crc, size):
    h = 42
    for x in (key, crc, size):
        if x is not None:
            h = xxhash.xxh64(struct.pack("<q", x), seed=h).intdigest()
    return h


def walked(docs, shards, vnodes, caps):
    """Key by key: own shard first, arc by arc; what is left walks on clockwise."""
    bits, points = sharding.ring_points(shards, vnodes)
    keys = []
    for d in docs:
        body = (d["text"] or "").encode()
        keys.append((ring_hash(d["doc_id"], zlib.crc32(body), len(body) + 1), d["doc_id"], len(body) + 1, zlib.crc32(body)))
    slots = [p for p, _ in points]
    home = lambda h: next((i for i, s in enumerate(slots) if (h >> (64 - bits)) <= s), 0)
    arcs = [[] for _ in points]
    for k in keys:
        arcs[home(k[0])].append(k)
    room, out, over, used = list(caps), [], [], [0] * shards

    def put(k, shard):
        out.append((k[1], k[2], k[3], "rows", shard, used[shard], None))
        used[shard] += 1
        room[shard] -= 1

    for i, arc in enumerate(arcs):
        # a key beyond the last point belongs to arc 0, behind those that start the ring
        for k in sorted(arc, key=lambda k: k[0]):
            if room[points[i][1]]:
                put(k, points[i][1])
            else:
                over.append((i, k))
    for i, k in over:
        while not room[points[i := (i + 1) % len(points)][1]]:
            pass
        put(k, points[i][1])
    return out


def test_sharding(spark, corpus):
    got = rows_of(spark, "op1_sharding", corpus)
    want = walked(corpus[1], 8, 64, sharding.capacities(len(corpus[1]), 8, 0.0))
    same(got, want)
    sizes = Counter(r[4] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r[5] for r in got if r[4] == shard) == list(range(n))


def test_sharding_moves_little_with_slack(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    at = {n: {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, n, slack=0.25).collect()} for n in (8, 9)}
    assert max(Counter(at[8].values()).values()) <= -(-1.25 * 3000 // 8)
    moved = sum(at[8][k] != at[9][k] for k in at[8])
    assert moved < 0.45 * 3000  # a modulus would move eight ninths


# ---- joins and duplicates ---------------------------------------------------------------


@pytest.mark.parametrize("tile", [256, 8])
def test_ngram_join(spark, corpus, tile):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    got = similar_texts(docs, tile=tile).collect()
    want = brute.components(corpus[1])
    same(
        [(r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got],
        [(d["doc_id"], n, low if n else d["doc_id"], links) for d, (n, low, links, _) in zip(corpus[1], want, strict=True)],
    )
    if tile == 256:
        same(
            [r[:3] for r in rows_of(spark, "op2_ngram_join", corpus)],
            [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got],
        )


def test_exact_dedup(spark, corpus):
    got = rows_of(spark, "op8_exact_dedup", corpus)
    groups = {}
    for d in corpus[1]:
        text = d["text"] or ""
        groups.setdefault("".join(brute.space_words(text)), []).append((-len(text), d["doc_id"] is None, d["doc_id"]))
    want = []
    for text, members in groups.items():
        members.sort(key=repr if any(m[2] is None for m in members) else None)
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        want += [(m[2], members[0][2], len(members), i == 0, brute.sha(text)) for i, m in enumerate(members)]
    same(got, want)


def test_exact_dedup_tells_collisions_apart(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    weak = ((3, 2), (2, 1))
    got = exact_dedup.exact_copies(docs, moduli=weak, size=1000).collect()
    same([(r["doc_id"], r["text_sha256"], r["group_size"]) for r in got], [(r[0], r[4], r[2]) for r in rows_of(spark, "op8_exact_dedup", corpus)])


def test_fingerprints_combine():
    data = bytes(range(256)) * 700
    whole = exact_dedup.chunk_hash(data[:1000])
    for cut in (0, 1, 400, 999, 1000):
        parts = [exact_dedup.chunk_hash(x) for x in (data[:cut], data[cut:1000])]
        assert exact_dedup.combine(*parts, 1000 - cut) == whole
    assert exact_dedup.fingerprint(data, size=64) == exact_dedup.fingerprint(data, size=65536)


def test_suffix_dedup(spark, corpus):
    want = [(d["doc_id"], *r) for d, r in zip(corpus[1], brute.repeats(corpus[1]), strict=True)]
    same(rows_of(spark, "op9_suffix_dedup", corpus), want)
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    by_string = suffix_dedup.repeats_removed(docs, frequent=1)  # every anchor takes the other route
    same([tuple(r) for r in by_string.withColumn("kept", F.sha2("kept", 256)).collect()], want)


# ---- scans ------------------------------------------------------------------------------


def test_licenses(spark, corpus):
    got = rows_of(spark, "op4_license_scan", corpus)
    same([r[:6] for r in got], [(d["doc_id"], *r) for d, r in zip(corpus[1], brute.licenses(corpus[1]), strict=True)])
    assert all(0 <= r[7] <= 1 and set(filter(None, r[5].split(","))) <= set(r[6].split(",")) for r in got)
    assert next(r for r in got if r[0] == 113)[6] == "cc-by,gpl,mit"


def test_secrets(spark, corpus):
    got = rows_of(spark, "op10_secret_scan", corpus)
    want = [(d["doc_id"], *brute.secrets(d["text"])) for d in corpus[1]]
    same([r[:5] for r in got], [w[:5] for w in want])
    base = {w[0]: set(filter(None, w[5].split(","))) for w in want}
    assert all(base[r[0]] <= set(r[5].split(",")) | {""} for r in got)
    by_id = {r[0]: r for r in got}
    assert "key:40:72" in by_id[112][5]  # a lone unlabelled key is reported
    assert by_id[0][7] > 0 and by_id[112][6] > 0  # the copied token is an example, the lone one live


def test_copies_inside_one_owner_are_examples(spark):
    def lone(i):
        return f"Ab{i:04d}cdEFghIJklMNopQRstUV"

    placeholder, twice = "sk_demo_0123456789abcdefghij", "Zz99yy88xx77ww66vv55uu44tt33"
    docs = [(i, f"set {placeholder} or {lone(i)}", None if i % 2 else "hot") for i in range(40)]
    docs += [(i, f"use {twice}", "hot") for i in (50, 50, 51)] + [(60, "token = 'secret99'", None)]
    got = {r["doc_id"]: r for r in secret_scan.op10_secret_scan(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    for i in range(40):
        assert (got[i]["n_live"], got[i]["n_example"], got[i]["spans"]) == (1, 1, "key:36:62")
        assert got[i]["holders"] == "key:4:32:2:20,key:36:62:1:1"
    assert [(got[i]["n_live"], got[i]["holders"]) for i in (50, 51)] == [(1, "key:4:32:1:2")] * 2
    assert (got[60]["n_live"], got[60]["holders"]) == (1, "assign:0:17:1:1")


def test_contamination(spark, corpus):
    want = brute.contamination(corpus[1], corpus[2])
    same(rows_of(spark, "op6_decontaminate", corpus), [(d["doc_id"], *r) for d, r in zip(corpus[1], want, strict=True)])
    assert any(w[4] for w in want)


# ---- models -----------------------------------------------------------------------------


def test_lm_scores(spark, corpus):
    got = sorted(rows_of(spark, "op7_lm_scoring", corpus), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = [(d["doc_id"], *r) for d, r in zip(corpus[1], brute.bigram_scores(corpus[1], kn_scoring.discounts), strict=True)]
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("pair_share", [0.0, 0.0005, 0.01])
def test_lm_scores_with_hot_pairs(spark, corpus, pair_share):
    """Scores are the same whatever share of the pairs is spread by chunk."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").repartition(3)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    named = docs.select(F.col("doc_id").alias("_key"), (~held).alias("_train"), F.col("text").alias("_text"))
    n = len(kn_scoring.frequent_pairs(named, pair_share, 1).pair)
    assert n >= {0.0: 1000, 0.0005: 5, 0.01: 1}[pair_share]
    got = kn_scoring.score_documents(docs, ~held, pair_share=pair_share, sample_of=1).collect()
    got = sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = [(d["doc_id"], *r) for d, r in zip(corpus[1], brute.bigram_scores(corpus[1], kn_scoring.discounts), strict=True)]
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-9)


def test_a_hot_pair_is_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(kn_scoring, "CHUNK_BYTES", 1 << 12)
    rows = [(i, f"w{i} x{i % 50} very common y{i % 70}" if i % 3 == 0 else f"a{i} b{i} c{i % 9}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    named = docs.select(F.col("doc_id").alias("_key"), F.lit(True).alias("_train"), F.col("text").alias("_text"))
    hot = kn_scoring.frequent_words(named, 0.02, 1)
    none = kn_scoring.HotPairs(hot[:0], hot[:0])
    pairs = kn_scoring.frequent_pairs(named, 0.02, 1)
    assert 1000 in pairs.count

    def largest(p):
        """Entries of the largest bucket, as a multiple of the mean."""
        sizes = Counter()
        for r in kn_scoring.entries(named, 16, hot, p).filter("not docs").collect():
            sizes[r["bucket"]] += len(packed.unpack(r["data"])["w"])
        return max(sizes.values()) / (sum(sizes.values()) / 16)

    assert largest(none) > 1.8 and largest(pairs) < 1.5


def test_word_counts_beyond_32_bits(spark):
    import numpy as np

    most, one = 2**32 - 1, lambda *x: np.array(x, np.uint64)
    rows = [  # bucket 0 counts word 7 beyond 32 bits alone, bucket 1 adds to it
        (0, 0, False, packed.pack(v=one(5), run=np.array([2], np.uint32), w=one(7, 7), doc=np.array([0, 1], np.uint16) | kn_scoring.TRAIN, n=np.array([most, most], np.uint32))),
        (1, 1, False, packed.pack(v=one(6), run=np.array([1], np.uint32), w=one(7), doc=np.array([0], np.uint16) | kn_scoring.TRAIN, n=np.array([most], np.uint32))),
    ]
    forward = spark.createDataFrame([(b, c, d, bytearray(x)) for b, c, d, x in rows], kn_scoring.ENTRY_DDL)
    told = kn_scoring.answers(kn_scoring.shares(forward, 2, np.array([1, 2], np.uint64), kn_scoring.HotPairs(one(), one()))).collect()
    got = [packed.unpack(bytes(r["data"])) for r in told]
    assert sorted((r["bucket"], a["w"].tolist(), a["tokens"].tolist(), a["kinds"].tolist()) for r, a in zip(told, got, strict=True)) == [
        (0, [7], [3 * most], [2]), (1, [7], [3 * most], [2])
    ]
    assert sum(r["tokens"] for r in told) == 3 * most


def test_language_id(spark, corpus):
    got = QUERIES["op5_language_id"](spark, corpus[0]).collect()
    same([(r["doc_id"], r["held_out"]) for r in got], [(d["doc_id"], brute.held_out(d, 3)) for d in corpus[1]])
    truth = {d["doc_id"]: d for d in corpus[1] if d["doc_id"] is not None and d["doc_id"] < 100}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held)
    assert held and right >= 0.9 * len(held)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (100, 101, 102, 103):
            assert (r["lang_pred"], r["rejected"]) == ("und", True)
    assert not any(r["rejected"] for r in got if r["doc_id"] in truth)


def test_left_out_language_is_rejected(spark):
    rng = random.Random(3)
    parts = {"en": "the ing and tion er with of th", "de": "der ung keit schl eine ich ü zw", "fr": "eau é oir que les ment ç ou"}

    def prose(lang):
        return " ".join("".join(rng.choices(parts[lang].split(), k=rng.choice((1, 2, 3)))) for _ in range(rng.choice((6, 20, 60, 200))))

    told = [(i, prose(lang), lang) for i in range(700) for lang in sorted(parts)]
    docs = spark.createDataFrame(told, "doc_id long, text string, lang string")
    for out in sorted(parts):
        model = langid.fit_models(docs.filter(F.col("lang") != out), "doc_id", "text", "lang", sample=250)
        got = langid.predict(docs, model, "text", ["lang"]).groupBy(F.col("lang") == out).agg(
            F.avg(F.col("rejected").cast("double"))
        )
        rejected = {r[0]: r[1] for r in got.collect()}
        assert rejected[True] > 0.95 and rejected[False] < 0.01


def test_limits_without_calibration_rows():
    import numpy as np

    lang, length, n = np.array([0, 0, 0, 1]), np.array([4, 4, 5, 4]), np.array([500, 1, 300, 500])
    got = langid.limits_of(3, lang, length, np.array([1.4, 1.6, 1.4, 1.5]), n, 3.0)
    assert np.isfinite(got).all() and got.max() < 2 and (np.diff(got, axis=1) <= 0).all()
    assert (got[2] > 1.4).all()  # the third language has no row: the pooled limit
    none = np.zeros(0, np.int64)
    assert (langid.limits_of(2, none, none, none / 1.0, none, 3.0) == 3.0).all()


def test_language_model_sums_to_one():
    model = langid.KneserNey(
        ["a"], [tuple(x for x in __import__("numpy").unique(langid.gram_keys(["banana bandana", "nab an"])[0], return_counts=True))]
    )
    import numpy as np

    letters = model.keys[1]
    for context in (0, int(model.contexts[4][3]), 0x610062):
        keys = (np.uint64(context) << np.uint64(16)) | letters
        seen = np.exp(model._lookup(keys, 4)[:, 0]).sum()
        other = np.exp(model._lookup(np.array([(context << 16) | 0x7A], np.uint64), 4)[0, 0])
        assert seen + other == pytest.approx(1, abs=1e-5)


def test_without_labels_all_is_undetermined(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.op5_language_id(docs).first()["lang_pred"] == "und"


# ---- helpers ----------------------------------------------------------------------------


def test_word_hashes_do_not_depend_on_the_pass(monkeypatch):
    texts = [b"", b"  a Bc\td ", b"x" * 3000, b"a bc d" * 500, b" "]
    hashes, sizes = packed.word_hashes(texts)
    monkeypatch.setattr(packed, "PASS_BYTES", 64)
    again, sizes_again = packed.word_hashes(texts)
    assert (hashes == again).all() and (sizes == sizes_again).all()
    assert sizes.tolist() == [len(t.split()) for t in texts] and hashes[0] == hashes[sizes[1] + 1]


def test_packed_round_trip():
    import numpy as np

    arrays = {"a": np.arange(5, dtype=np.uint64), "b": np.zeros(0, bool), "c": np.array([1.5])}
    back = packed.unpack(packed.pack(**arrays))
    assert all((back[k] == v).all() and len(back[k]) == len(v) for k, v in arrays.items())
