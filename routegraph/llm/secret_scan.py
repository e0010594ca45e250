"""Secret scans that weigh candidates by how widely the corpus shares them.

Candidates are credential-like strings with their places. For the whole corpus, the
distinct owners of every candidate's hash and its distinct repositories at each owner are
counted: a string that many owners hold, or one owner in many repositories, is an example
that got copied; one with no more than ``live_owners`` owners and ``live_repos``
repositories at any of them is likely live. Beyond the three base kinds the scan finds
unlabelled keys that look generated (long runs mixing letters and digits outside the base
spans) and reports the live ones. Both counts are returned for every candidate.

A row's candidates stay in arrays of the written scan table, so the text is read once and
never shuffled. Counting goes hash, owner, repository, each a grouped count with partial
results, so one string in a third of the documents does not meet in one task.

Defined results: a null text is an empty text; a null owner is an owner like any other;
repeated rows count as one repository; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegraph.llm.common import let, owner, text_or_empty, written

#: Fixed patterns of the base kinds, in the order of the contract: (kind, pattern, group of
#: the secret, least length of that group).
BASE = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Unlabelled keys: runs that hold a digit and a letter.
KEY = ("key", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{24,}", 0, 24)
KINDS = [k[0] for k in (*BASE, KEY)]

SPAN = "struct<start:int,kind:int,end:int,hash:bigint>"


#: Elements of an array that one fold collects; its copies of what it has grow with their square.
FOLD = 512


def scanned(items: Column, value, op, zero: int, emit) -> Column:
    """``emit(state, item)`` for every item, the state being ``op`` over the values before it.

    Folds over stretches of ``FOLD`` items, each begun with what ``op`` gives for the stretches
    before: what a fold has collected is copied at every step, so one fold over the whole
    array would take time with the square of its length.
    """
    last = F.floor((F.size(items) - 1) / FOLD).cast("int")
    stretches = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * FOLD + 1, F.lit(FOLD)))
    totals = F.transform(stretches, lambda c: F.aggregate(c, F.lit(zero), lambda a, x: op(a, value(x))))

    def collect(over: Column, start: Column, step, out) -> Column:
        none = F.slice(F.transform(over, lambda x: out(start, x)), 1, 0)
        return F.aggregate(
            over, F.struct(start.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                op(acc["at"], step(x)).alias("at"), F.concat(acc["out"], F.array(out(acc["at"], x))).alias("out")
            ),
            lambda acc: acc["out"],
        )

    starts = collect(totals, F.lit(zero), lambda x: x, lambda at, x: at)
    return F.flatten(F.zip_with(stretches, starts, lambda c, start: collect(c, start, value, emit)))


def matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches with code point places, less those too short.

    ``split`` gives the stretches between the matches that ``regexp_extract_all`` gives, so
    a running sum of both lengths gives the places.
    """
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    parts = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"),
        whole.alias("whole"),
        (F.regexp_extract_all(text, p, F.lit(group)) if group else whole).alias("secret"),
    )

    def span(at: Column, m: Column) -> Column:
        start = at + F.length(m["gap"])
        return F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m["whole"])).alias("end"),
            F.xxhash64(m["secret"]).alias("hash"), (F.length(m["secret"]) >= least).alias("long"),
        )

    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    found = let(
        parts,
        lambda hits: F.transform(
            F.filter(scanned(hits, lambda m: F.length(m["gap"]) + F.length(m["whole"]), Column.__add__, 0, span), lambda s: s["long"]),
            plain,
        ),
    )
    return F.when(F.regexp_like(text, p), found).otherwise(none)


def plain(span: Column) -> Column:
    return F.struct(*[span[f].alias(f) for f in ("start", "kind", "end", "hash")])


def apart(keys: Column, base: Column) -> Column:
    """Those of ``keys`` that no span of ``base`` overlaps, both sorted by start.

    In the merged order, a base span before a key overlaps it if the furthest end so far lies
    beyond the key's start, one behind it if the next base span starts before its end.
    """
    far = (1 << 31) - 1
    is_key = lambda s: s["kind"] == len(BASE)

    def flagged(over: Column) -> Column:
        def mark(at: Column, s: Column) -> Column:
            return F.struct(*[s[f].alias(f) for f in ("start", "kind", "end", "hash")], (at <= s["start"]).alias("free"))

        return scanned(over, lambda s: F.when(is_key(s), 0).otherwise(s["end"]), F.greatest, 0, mark)

    def kept(at: Column, s: Column) -> Column:
        return F.struct(*[s[f].alias(f) for f in ("start", "kind", "end", "hash")], (s["free"] & is_key(s) & (at >= s["end"])).alias("free"))

    def both(merged: Column) -> Column:
        back = F.reverse(flagged(merged))
        ends = let(back, lambda b: scanned(b, lambda s: F.when(is_key(s), far).otherwise(s["start"]), F.least, far, kept))
        return F.transform(F.filter(F.reverse(ends), lambda s: s["free"]), plain)

    merged = let(F.sort_array(F.concat(base, keys)), both)
    return F.when((F.size(keys) == 0) | (F.size(base) == 0), keys).otherwise(merged)


def joined(spans: Column, *more: str) -> Column:
    """kind:start:end of sorted spans, and more of their fields, comma-joined."""
    kinds = F.lit(KINDS)
    fields = ("start", "end", *more)
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), *[s[f] for f in fields])), ","
    )


@owner
def scan_secrets(
    docs: DataFrame, repo: str = "doc_id", owner: str = "source", text: str = "text",
    live_owners: int = 2, live_repos: int = 4,
) -> DataFrame:
    """(repo, base, spans, n_live, n_example, holders) for every row: base spans, all spans,
    verdicts, and (start, kind, end, owners, most repositories at one owner) of all candidates."""
    found = written(
        docs.select(F.col(repo).alias("_repo"), F.col(owner).alias("_owner"), text_or_empty(text).alias("_text"))
        .select(
            "_repo", "_owner",
            F.sort_array(F.concat(*[matches(F.col("_text"), k, p, g, n) for k, (_, p, g, n) in enumerate(BASE)])).alias("_base"),
            matches(F.col("_text"), len(BASE), *KEY[1:]).alias("_keys"),
        )
        .withColumn("_keys", apart(F.col("_keys"), F.col("_base")))
        .withColumn("_row", F.monotonically_increasing_id()),
        "secret-candidates",
    )
    candidates = found.filter("size(_base) + size(_keys) > 0").select(
        "_row", "_repo", "_owner", F.inline(F.concat("_base", "_keys"))
    )
    spread = written(
        candidates.groupBy("hash", "_owner", "_repo").agg(F.count(F.lit(1)).alias("_copies"))
        .groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("_repos"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("_owners"), F.max("_repos").alias("_repos")),
        "secret-spread",
    )
    live = (F.col("_owners") <= live_owners) & (F.col("_repos") <= live_repos)
    verdicts = candidates.join(spread, "hash").groupBy("_row").agg(
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_example"),
        F.collect_list(
            F.when(live & (F.col("kind") == len(BASE)), F.struct("start", "kind", "end", "hash"))
        ).alias("_owned"),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "_owners", "_repos"))).alias("_holders"),
    )
    none = F.filter("_keys", lambda s: F.lit(False))
    nobody = F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int,_owners:bigint,_repos:bigint>>")
    return found.join(verdicts, "_row", "left").select(
        F.col("_repo").alias(repo),
        F.col("_base").alias("base"),
        F.sort_array(F.concat("_base", F.coalesce("_owned", none))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.coalesce("_holders", nobody).alias("holders"),
    )


def op10_secret_scan(docs: DataFrame) -> DataFrame:
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scan_secrets(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
        joined(F.col("holders"), "_owners", "_repos").alias("holders"),
    )
