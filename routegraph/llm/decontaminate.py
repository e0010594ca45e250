"""Benchmark decontamination by winnowing.

Training texts and benchmark items are cut into words. Over the hashes of all ``k``-word
grams, the smallest hash of every window of ``span`` words is kept as the window's
fingerprint: two texts that share ``span`` consecutive words share a fingerprint. The
distinct fingerprints of the texts are joined with those of the items. In the texts that
hit, every window whose fingerprint was hit is extended to its words and compared with the
items' windows; the windows that are equal cover the hit words.

Items of fewer than ``span`` words are one window of their own length. They have no full
winnowing window; texts are matched on every gram of the largest power of two that the
item holds, anchored at the item's first word, and only if such items exist.

The list of texts that hit is broadcast when its counted size is under ``BROADCAST_ROWS``;
above it, the texts are joined by shuffling.

Defined results: null and empty texts have no words, no hits and are not contaminated;
items without words are ignored; items with equal text count each; rows with equal keys
and texts get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegraph.llm.common import alnum_words, ascii_lower, discard, let, owner, text_or_empty, written

SPAN = 13
GRAM = 5
#: Fingerprints, of 16 bytes or so, that a broadcast may hold.
BROADCAST_ROWS = 1_000_000


def grams(words: Column, k: int) -> Column:
    """Hashes of all k-word grams; null for fewer words."""
    starts = F.sequence(F.lit(1), F.size(words) - (k - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))
    return F.when(F.size(words) >= k, hashes)


def winnow(hashes: Column, width: int) -> Column:
    """The smallest hash of every ``width`` consecutive ones; null for fewer."""

    def lows(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (width - 1))
        return F.when(
            F.size(h) >= width, F.transform(starts, lambda i: F.array_min(F.slice(h, i, F.lit(width))))
        )

    return let(hashes, lows)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def window_text(words: Column, start: Column, n: Column) -> Column:
    """The words from ``start`` (0-based), spaces between: no word holds a space."""
    return F.array_join(F.slice(words, start + 1, n), " ")


def prints(words: Column, n: int, span: int, k: int) -> Column:
    """For every window of ``n`` words, its fingerprint (its first gram's hash where n < span)."""
    if n == span:
        return winnow(grams(words, k), span - k + 1)
    return grams(words, 1 << (n.bit_length() - 1))


def item_windows(items: DataFrame, span: int, key: str, text: str) -> DataFrame:
    """(n, window, items): every distinct window of the items, with the items that hold it."""
    words = items.select(F.col(key).alias("item"), alnum_words(ascii_lower(text_or_empty(text))).alias("_w"))
    return (
        words.filter(F.size("_w") > 0)
        .withColumn("n", F.least(F.size("_w"), F.lit(span)))
        .withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("_w") - F.col("n"))))
        .groupBy("n", window_text(F.col("_w"), F.col("_at"), F.col("n")).alias("window"))
        .agg(F.collect_set("item").alias("items"))
    )


@owner
def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = GRAM,
) -> DataFrame:
    """(_key, _hash, n_words, hits, items) for every row of ``docs``; _hash is its text's hash.

    ``hits`` are the places (first word, end) of the windows that occur; ``items`` the items
    they belong to.
    """
    windows = written(item_windows(items, span, item_key, item_text), "bench-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # span at most
    body = text_or_empty(text)
    named = docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("_hash"), body.alias("_text"))
    words = alnum_words(ascii_lower(F.col("_text")))

    def by_length(w: Column, distinct: bool) -> Column:
        keep = F.array_distinct if distinct else (lambda c: c)
        told = [F.struct(F.lit(n).alias("n"), keep(prints(w, n, span, k)).alias("prints")) for n in lengths]
        return F.array(*told)

    if not lengths:
        rows = named.select("_key", "_hash", F.size(words).alias("n_words"))
        none = {"hits": "array<struct<at:int,end:int>>", "items": "array<string>"}
        return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])

    index = written(
        windows.select(F.explode(let(F.split("window", " "), lambda w: by_length(w, True))).alias("t"), F.col("n").alias("_n"))
        .filter(F.col("t.n") == F.col("_n"))
        .select("t.n", F.get("t.prints", F.lit(0)).alias("print"))
        .distinct(),
        "bench-prints",
    )
    marked = written(
        named.select(
            "_key", "_hash",
            let(words, lambda w: F.struct(F.size(w).alias("n_words"), by_length(w, True).alias("_told"))).alias("m"),
        ).select("_key", "_hash", "m.*"),
        "text-prints",
    )
    exploded = (
        marked.select("_key", "_hash", F.explode("_told").alias("t"))
        .select("_key", "_hash", "t.n", F.explode("t.prints").alias("print"))
    )
    known = _small(index, index.count())
    hit = written(
        exploded.join(known, ["n", "print"]).groupBy("_key", "_hash").agg(F.collect_set(F.struct("n", "print")).alias("_hit")),
        "text-hits",
    )
    discard(index)
    n_hit = hit.agg(F.sum(F.size("_hit")).alias("n")).first()["n"] or 0
    close = named.join(
        _small(hit, n_hit).select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "_hit"),
        F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")),
    )

    def places(w: Column, n: int) -> Column:
        marks = F.transform(
            prints(w, n, span, k),
            lambda p, i: F.when(
                F.array_contains("_hit", F.struct(F.lit(n).alias("n"), p.alias("print"))),
                F.struct(F.lit(n).alias("n"), i.alias("at"), window_text(w, i, F.lit(n)).alias("window")),
            ),
        )
        none = F.from_json(F.lit("[]"), "array<struct<n:int,at:int,window:string>>")
        return F.coalesce(F.array_compact(marks), none)

    spots = let(words, lambda w: F.concat(*[places(w, n) for n in lengths]))
    texts = close.select("_key", "_hash", F.inline(spots))
    found = (
        texts.join(windows, ["n", "window"])
        .groupBy("_key", "_hash")
        .agg(
            F.collect_set(F.struct(F.col("at"), (F.col("at") + F.col("n")).alias("end"))).alias("hits"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
        .select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "hits", "items")
    )
    rows = marked.select("_key", "_hash", "n_words")
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))
    return rows.join(found, same, "left").drop("_k", "_h")


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to the rows of ``contamination``."""
    covered = F.aggregate(
        F.sort_array("hits"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["at"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return (
        found.withColumn("n_words", F.col("n_words").cast("long"))
        .withColumn("n_hit", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("n_items", F.coalesce(F.array_size("items"), F.lit(0)).cast("long"))
        .withColumn("items_sha256", F.sha2(F.coalesce(ids, F.lit("")).cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def op6_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of the query, one row per row of ``docs``."""
    return judged(contamination(docs, items)).select(
        F.col("_key").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(i) WHERE len(w) > 0
), ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, ns, unnest(range(1, len(w) - n + 2)) AS u(i)
), h AS (
  SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) AS v(p) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
