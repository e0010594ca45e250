"""Perplexity scoring with an interpolated modified Kneser-Ney bigram model.

Spark counts the n-grams and routes every question to the counts it needs, so no worker
holds the whole model:

1. every document's (word before, word, document) entries go to the bucket of the word
   before; the pairs of a few very frequent words (their number is bounded by the buckets)
   spread over all buckets by pair, and the entries of very frequent pairs by chunk of
   documents: these pairs are counted before, and each counts in one bucket of its own;
2. each bucket counts its training pairs and sends, for the words it has seen, its share of
   their counts and of their distinct left neighbours to the word's own bucket, which adds
   them up and answers;
3. with the answers each bucket writes its shard of the model, sorted hash arrays, to a
   scratch file, maps it into memory and scores its entries by binary search; the sums per
   document are added up per chunk of documents.

The count-of-counts that fix the discounts are one row of sums. Hashes have 64 bits.

Defined results: a null text is an empty text with its end token; without training rows all
words are unknown and all scores 0; repeated rows are scored each; an empty table gives no
rows; keys are integers.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegraph.llm.packed import (
    bucket_of, buckets_for, doc_chunks, grouped, mix, narrow, pack, rows_of, split, text_bytes, unpack, word_hashes,
)

END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A7757A7757A771)
#: Text of one chunk of documents; a chunk has at most 1 << 14 rows.
CHUNK_BYTES = 8 << 20
#: Bit of a document's number in its chunk that marks training documents.
TRAIN = np.uint16(1 << 15)
#: Text behind one bucket of pairs: its arrays take some 30 times as much while it is scored.
BUCKET_BYTES = 8 << 20

#: One document in so many tells which words and pairs are frequent, and the least share of the
#: tokens that makes a pair so: no more than a million pairs, 40 bytes each, go to the workers.
SAMPLE_OF, LEAST_SHARE = 64, 1e-6

ENTRY = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("docs", pa.bool_()), ("data", pa.binary())])
ENTRY_DDL = "bucket int, chunk long, docs boolean, data binary"
SUMS = ["n1", "n2", "n3", "n4", "t1", "t2", "t3", "t4", "types", "tokens", "kinds"]
SHARE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary()), *[(s, pa.int64()) for s in SUMS]])
SHARE_DDL = "bucket int, chunk long, data binary, " + ", ".join(f"{s} long" for s in SUMS)
PART = pa.schema([("chunk", pa.int64()), ("docs", pa.bool_()), ("data", pa.binary())])


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token before, token, text number) of all tokens, ends included."""
    words, sizes = word_hashes(texts)
    ends = np.cumsum(sizes + 1) - 1
    w = np.empty(len(words) + len(texts), np.uint64)
    is_word = np.ones(len(w), bool)
    is_word[ends] = False
    w[is_word], w[ends] = words, END
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[ends - sizes] = START
    return v, w, np.repeat(np.arange(len(texts), dtype=np.uint16), sizes + 1)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(29))))


def frequent_words(docs: DataFrame, share: float, sample_of: int = SAMPLE_OF) -> np.ndarray:
    """Words that make up ``share`` of the tokens of about every 64th document, and START.

    They decide only where entries go. At most 1 / share words reach the driver.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in doc_chunks(batches, CHUNK_BYTES):
            w, n = np.unique(tokens_of(texts)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])

    counts = sampled(docs, sample_of).mapInArrow(scan, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    top = counts.filter(F.col("n") >= share * total).select("w").collect()
    return np.unique(np.array([START, END] + [np.int64(r["w"]).view(np.uint64) for r in top], np.uint64))


def sampled(docs: DataFrame, sample_of: int) -> DataFrame:
    return docs.filter(F.pmod(F.xxhash64("_key", "_text"), F.lit(sample_of)) == 0).select("_text")


class HotPairs:
    """Pairs whose entries are spread over all buckets: sorted hashes, words, training counts."""

    def __init__(self, v: np.ndarray, w: np.ndarray) -> None:
        pair = pair_hash(v, w)
        order = np.argsort(pair)
        self.pair, self.v, self.w = pair[order], v[order], w[order]
        self.count = np.zeros(len(pair), np.int64)

    def has(self, pair: np.ndarray) -> np.ndarray:
        return Shard.find(self.pair, pair)[1]

    def held(self, pair: np.ndarray) -> np.ndarray:
        """Which of the hot pairs that training rows have are among ``pair``."""
        out = np.zeros(len(self.pair), bool)
        for first in range(0, len(pair) if len(out) else 0, 1 << 20):  # a stretch at a time, for memory
            at, hit = Shard.find(self.pair, pair[first : first + (1 << 20)])
            out[at[hit]] = True
        return out & (self.count > 0)


def frequent_pairs(docs: DataFrame, share: float, sample_of: int = SAMPLE_OF) -> HotPairs:
    """Pairs that make up ``share`` of the tokens of a sample, counted in all training rows.

    No more than 1 / share pairs reach the driver. The words before them are as frequent, so
    ``frequent_words`` of the same share has those, too.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in doc_chunks(batches, CHUNK_BYTES):
            v, w, _ = tokens_of(texts)
            _, at, n = np.unique(pair_hash(v, w), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(n)], names=["v", "w", "n"]
            )

    counts = sampled(docs, sample_of).mapInArrow(scan, "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    found = counts.filter(F.col("n") >= share * total).select("v", "w").toArrow()
    hot = HotPairs(*(found.column(c).to_numpy().view(np.uint64) for c in "vw"))
    if not len(hot.pair):
        return hot

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, train), texts in doc_chunks(batches, CHUNK_BYTES):
            v, w, doc = tokens_of(texts)
            at, hit = Shard.find(hot.pair, pair_hash(v, w))
            n = np.bincount(at[hit & np.asarray(train.to_pylist(), bool)[doc]], minlength=len(hot.pair))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["at", "n"])

    for r in docs.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        hot.count[r["at"]] = r["n"]
    return hot


def entries(docs: DataFrame, n_buckets: int, hot: np.ndarray, pairs: HotPairs) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, (keys, train), texts in doc_chunks(batches, CHUNK_BYTES):
            v, w, doc = tokens_of(texts)
            held = np.asarray(train.to_pylist(), bool)
            sizes = np.bincount(doc, minlength=len(texts))
            ids = keys.cast(pa.int64())
            about = pack(
                key=ids.fill_null(0).to_numpy(), null=np.asarray(ids.is_null().to_pylist(), bool), train=held, tokens=sizes
            )
            rows = [(chunk % n_buckets, chunk, True, about)]
            order = np.argsort((v & np.uint64(0xFFFFFFFF00000000)) | (w >> np.uint64(32)), kind="stable")
            v, w, doc = v[order], w[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])]))
            n = np.diff(np.append(new, len(v)))
            v, w, doc = v[new], w[new], doc[new]
            at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
            pair = pair_hash(v, w)
            spread = mix(pair + np.uint64(chunk) * np.uint64(0x9E3779B97F4A7C15))
            pair = np.where(pairs.has(pair), spread, pair)
            bucket = np.where(hot[at] == v, bucket_of(pair, n_buckets), bucket_of(v, n_buckets))
            for b, (bv, bw, bd, bn) in split(bucket, n_buckets, v, w, doc, n):
                run = np.flatnonzero(np.concatenate([[True], bv[1:] != bv[:-1]]))
                lens = np.diff(np.append(run, len(bv))).astype(np.uint32)
                small = np.uint8 if bn.max() < 256 else np.uint32
                marked = np.where(held[bd], bd | TRAIN, bd).astype(np.uint16)
                rows.append((b, chunk, False, pack(v=bv[run], run=lens, w=bw, doc=marked, n=bn.astype(small))))
            yield rows_of(rows, ENTRY)

    scanned = docs.mapInArrow(scan, ENTRY_DDL)
    if not len(pairs.pair):
        return scanned
    # the bucket in which a hot pair counts may have no entries: an empty one makes it be there
    none = np.zeros(0, np.uint64)
    empty = pack(v=none, run=none.astype(np.uint32), w=none, doc=none.astype(np.uint16), n=none.astype(np.uint8))
    own = [(int(b), -1, False, empty) for b in np.unique(bucket_of(pairs.pair, n_buckets))]
    return scanned.unionByName(docs.sparkSession.createDataFrame(own, ENTRY_DDL))


class Bucket:
    """The entries of one bucket side by side, and the counts of its training pairs.

    Hot pairs are among these in their own bucket only, with their counts over all buckets.
    """

    def __init__(self, table: pa.Table, n_buckets: int, hot: HotPairs) -> None:
        self.docs, self.chunks, parts = [], [], []
        for chunk, docs, data in zip(*(table.column(c).to_pylist() for c in ("chunk", "docs", "data")), strict=True):
            if docs:
                self.docs.append((chunk, True, data))
                continue
            x = unpack(data)
            parts.append((np.repeat(x["v"], x["run"]), x["w"], x["doc"], x["n"].astype(np.uint32)))
            self.chunks.append((chunk, len(x["w"])))
        if not parts:
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint32))]
        self.v, self.w, doc, self.n = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        self.doc = doc & ~TRAIN
        self.pair = pair_hash(self.v, self.w)
        rows = np.flatnonzero(doc & TRAIN)
        rows = rows[np.argsort(self.pair[rows], kind="stable")]
        sorted_pairs = self.pair[rows]
        first = np.flatnonzero(np.concatenate([[True], sorted_pairs[1:] != sorted_pairs[:-1]])) if len(rows) else rows
        pairs = sorted_pairs[first]
        count = np.add.reduceat(self.n[rows].astype(np.int64), first) if len(rows) else np.zeros(0, np.int64)
        spread = hot.has(pairs)
        own = (bucket_of(hot.pair, n_buckets) == table.column("bucket")[0].as_py()) & (hot.count > 0)
        self.count = np.concatenate([count[~spread], hot.count[own]])
        rows = rows[first][~spread]
        self.pair_v, self.pair_w = np.concatenate([self.v[rows], hot.v[own]]), np.concatenate([self.w[rows], hot.w[own]])
        # what entries are scored with: the bucket's pairs, and all hot pairs that it holds
        held = hot.held(self.pair)
        known = np.concatenate([pairs[~spread], hot.pair[held]])
        order = np.argsort(known)
        self.pairs, self.pair_count = known[order], np.concatenate([count[~spread], hot.count[held]])[order]
        # contexts of the training pairs: tokens after them, and pairs seen once, twice, more
        self.contexts, own = np.unique(self.pair_v, return_inverse=True)
        size = len(self.contexts)
        weigh = lambda x: np.bincount(own, x, size).astype(np.int64)
        self.after = np.stack(
            [weigh(self.count), weigh(self.count == 1), weigh(self.count == 2), weigh(self.count > 2)], 1
        ) if size else np.zeros((0, 4), np.int64)
        self.words = np.unique(np.concatenate([self.w, self.pair_w]))


def shares(forward: DataFrame, n_buckets: int, hot: np.ndarray, pairs: HotPairs) -> DataFrame:
    """What each bucket of pairs adds to the counts of its words, to the words' buckets."""

    def count(table: pa.Table) -> Iterator[tuple]:
        own = table.column("bucket")[0].as_py()
        b = Bucket(table, n_buckets, pairs)
        at = np.searchsorted(b.words, b.pair_w)
        tokens = np.bincount(at, b.count, len(b.words)).astype(np.int64)
        kinds = np.bincount(at, minlength=len(b.words))
        mine = np.isin(b.contexts, hot)
        sums = [int((b.count == i).sum()) for i in (1, 2, 3, 4)] + [0] * 7
        word_parts = {k: x for k, x in split(bucket_of(b.words, n_buckets), n_buckets, b.words, tokens, kinds)}
        none = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        hot_parts = {k: x for k, x in split(bucket_of(b.contexts[mine], n_buckets), n_buckets, b.contexts[mine], b.after[mine])}
        # every bucket also asks for the totals of all hot contexts that its entries have
        asked = np.intersect1d(np.unique(b.v), hot)
        ask_parts = {k: x[0] for k, x in split(bucket_of(asked, n_buckets), n_buckets, asked)}
        for k in sorted({*word_parts, *hot_parts, *ask_parts}):
            w, t, d = word_parts.get(k, none)
            hv, after = hot_parts.get(k, (none[0], np.zeros((0, 4), np.int64)))
            ask = ask_parts.get(k, none[0])
            yield k, own, pack(w=w, tokens=narrow(t), kinds=narrow(d), hot=hv, after=after.ravel(), ask=ask), *sums
            sums = [0] * len(SUMS)

    return grouped(forward, "bucket", count, SHARE, SHARE_DDL)


def answers(parts: DataFrame) -> DataFrame:
    """Totals for the words that each bucket of pairs asked for, in its order."""

    def add(table: pa.Table) -> Iterator[tuple]:
        own = table.column("bucket")[0].as_py()
        asked = [unpack(d) for d in table.column("data").to_pylist()]
        sums = [sum(table.column(s).to_pylist()) for s in SUMS]

        def total(key: str, *values: str) -> tuple[np.ndarray, list[np.ndarray]]:
            keys, at = np.unique(np.concatenate([a[key] for a in asked]), return_inverse=True)
            return keys, [np.bincount(at, np.concatenate([a[v] for a in asked]), len(keys)).astype(np.int64) for v in values]

        words, (tokens, kinds) = total("w", "tokens", "kinds")
        for a in asked:
            a |= {f"after{i}": a["after"].reshape(-1, 4)[:, i] for i in range(4)}
        contexts, after = total("hot", *[f"after{i}" for i in range(4)])
        sums[4:8] = [int((kinds == i).sum()) for i in (1, 2, 3, 4)]
        sums[8:] = [int((tokens > 0).sum()), int(tokens.sum()), int(kinds.sum())]
        for to, a in zip(table.column("chunk").to_pylist(), asked, strict=True):
            at = np.searchsorted(words, a["w"])
            known = a["ask"][np.isin(a["ask"], contexts)]
            h = np.searchsorted(contexts, known)
            data = pack(
                w=a["w"], tokens=narrow(tokens[at]), kinds=narrow(kinds[at]),
                hot=known, after=np.stack([x[h] for x in after], 1).ravel() if len(h) else np.zeros(0, np.int64),
            )
            yield to, own, data, *sums
            sums = [0] * len(SUMS)

    return grouped(parts, "bucket", add, SHARE, SHARE_DDL)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and more, from the numbers of n-grams seen 1 to 4 times."""
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))])


class Shard:
    """One bucket's part of the model: sorted hash arrays, memory-mapped from a scratch file."""

    def __init__(self, folder: str, **arrays: np.ndarray) -> None:
        for name, a in arrays.items():
            path = os.path.join(folder, f"{name}.npy")
            np.save(path, a)
            setattr(self, name, np.load(path, mmap_mode="r") if a.size else a)

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the sorted keys, whether they are there)."""
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted


def bucket_scores(b: Bucket, got: list[dict[str, np.ndarray]], g: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base term, log10 probability, training count of the token) for the entries of a bucket."""
    words = np.concatenate([a["w"] for a in got])
    order = np.argsort(words)
    hot = np.concatenate([a["hot"] for a in got])
    hot_after = np.concatenate([a["after"] for a in got]).reshape(-1, 4)
    mine = ~np.isin(b.contexts, hot)
    contexts, after = np.concatenate([b.contexts[mine], hot]), np.concatenate([b.after[mine], hot_after])
    by_context = np.argsort(contexts)
    with tempfile.TemporaryDirectory() as folder:
        m = Shard(
            folder, pairs=b.pairs, count=b.pair_count, words=words[order],
            tokens=np.concatenate([a["tokens"] for a in got])[order].astype(np.float64),
            kinds=np.concatenate([a["kinds"] for a in got])[order].astype(np.float64),
            contexts=contexts[by_context], after=after[by_context].astype(np.float64),
        )
        at, _ = m.find(m.words, b.w)
        tokens, kinds = np.asarray(m.tokens)[at], np.asarray(m.kinds)[at]
        size = g["types"] + 1
        du = discounts(g["t1"], g["t2"], g["t3"], g["t4"])
        if g["kinds"]:
            more = g["types"] - g["t1"] - g["t2"]
            rest = (du[1] * g["t1"] + du[2] * g["t2"] + du[3] * more) / g["kinds"]
            p = np.maximum(kinds - du[np.minimum(kinds, 3).astype(int)], 0) / g["kinds"] + rest / size
        else:
            p = np.full(len(kinds), 1 / size)
        d = discounts(g["n1"], g["n2"], g["n3"], g["n4"])
        at, known = m.find(m.contexts, b.v)
        if known.any():
            after = np.asarray(m.after)[at]
            gamma = (after[:, 1:] * d[1:]).sum(1) / np.maximum(after[:, 0], 1)
            at, seen = m.find(m.pairs, b.pair)
            c = np.where(seen, np.asarray(m.count)[at], 0)
            top = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(after[:, 0], 1)
            p = np.where(known, top + gamma * p, p)
    return np.log10(tokens + 0.5), np.log10(p), tokens


def scored(forward: DataFrame, totals: DataFrame, n_buckets: int, pairs: HotPairs) -> DataFrame:
    """Per chunk of documents, its rows' keys and the sums of every bucket."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Bucket(left, n_buckets, pairs)
        rows = list(b.docs)
        if len(b.w):
            g = right.column("totals")[0].as_py()
            base, logp, tokens = bucket_scores(b, [unpack(d) for d in right.column("data").to_pylist()], g)
            first = 0
            for chunk, n in b.chunks:
                if not n:
                    continue
                s = slice(first, first + n)
                first += n
                doc, times = b.doc[s].astype(np.int64), b.n[s]
                present = np.unique(doc)
                add = lambda x: np.bincount(doc, x * times)[present]
                rows.append((chunk, False, pack(
                    doc=present.astype(np.uint16), base=add(base[s]), score=add(logp[s]), known=add(tokens[s] > 0).astype(np.uint32)
                )))
        return pa.Table.from_batches([rows_of(rows, PART)], schema=PART)

    return forward.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(score, "chunk long, docs boolean, data binary")


RESULT = pa.schema([
    ("key", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base", pa.float64()), ("score", pa.float64()),
])


def per_document(parts: DataFrame) -> DataFrame:
    def add(table: pa.Table) -> Iterator[tuple]:
        about, sums = None, []
        for docs, data in zip(table.column("docs").to_pylist(), table.column("data").to_pylist(), strict=True):
            if docs:
                about = unpack(data)
            else:
                sums.append(unpack(data))
        size = len(about["key"])
        doc = np.concatenate([s["doc"] for s in sums]).astype(np.int64)
        total = {k: np.bincount(doc, np.concatenate([s[k] for s in sums]), size) for k in ("base", "score", "known")}
        keys = [None if null else int(k) for k, null in zip(about["key"], about["null"], strict=True)]
        yield from zip(
            keys, (~about["train"]).tolist(), about["tokens"].tolist(), total["known"].astype(int).tolist(),
            total["base"].tolist(), total["score"].tolist(), strict=True,
        )

    return grouped(parts, "chunk", add, RESULT, "key long, held_out boolean, n_tokens long, n_known long, base double, score double")


def score_documents(
    docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text",
    pair_share: float | None = None, sample_of: int = SAMPLE_OF,
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    size = text_bytes(docs, text)
    n_buckets = buckets_for(docs, size, BUCKET_BYTES)
    rows = docs.select(F.col(key).cast("long").alias("_key"), train.alias("_train"), F.col(text).alias("_text"))
    share = 1 / (4 * n_buckets)
    pair_share = max(share, LEAST_SHARE) if pair_share is None else pair_share
    hot = frequent_words(rows, min(share, pair_share), sample_of)
    pairs = frequent_pairs(rows, pair_share, sample_of)
    forward = entries(rows, n_buckets, hot, pairs)
    told = answers(shares(forward, n_buckets, hot, pairs))
    totals = told.select(F.struct(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in SUMS])).scalar()
    parts = scored(forward, told.select("bucket", "data", totals.alias("totals")), n_buckets, pairs)
    n, v = totals["tokens"], totals["types"]
    return per_document(parts).select(
        F.col("key").alias(key), "held_out", "n_tokens", "n_known", n.alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(n + 0.5 * (v + 1))).alias("base_score"), "score",
    )


def op7_lm_scoring(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return score_documents(docs, ~held)
