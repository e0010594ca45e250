"""Conversation repair, spelling variants and WARC archives against brute force."""

from __future__ import annotations

import heapq
import random
import re
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from routegraph.llm import conversation_repair as repair_module
from routegraph.llm import spelling, warc
from routegraph.llm.queries import QUERIES
from routegraph.operators.lineage import RoundTables

# ---- conversation repair -----------------------------------------------------------------


def hurt(rows):
    """Ordered rows of every conversation after damage, straight from the contract."""
    out = {}
    show = lambda x: " " if x is None else str(x)
    for r in rows:
        mine = out.setdefault(r["conv_id"], [])
        h = zlib.crc32(f"{show(r['conv_id'])}:{show(r['turn'])}".encode()) % 20
        role, text = show(r["role"]), show(r["text"])
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        if h:
            mine += [(r["turn"], "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(cost, audit, repaired lines): paths in the order of their cost, all of the least one."""
    heap, done, ends, least = [(0, "", 0, "", ())], set(), [], None
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if least is not None and cost > least:
            break
        if (audit, roles) in done:
            continue
        done.add((audit, roles))
        tail = roles[-1:] if roles != "s" else "s"
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            least = cost
            ends.append((cost, audit, lines))
        want = "a" if tail == "u" else "u"
        name = {"u": "user", "a": "assistant"}[want]
        if len(roles) <= 2 * len(rows):
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + want, (*lines, f"{name}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, lines))
        if kinds[i] not in ("blank", "duplicate"):
            more = kinds[i] == "truncated"
            heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + want, (*lines, f"{name}:{text}")))
            if role[:1] == want or role[:1] == "s" and not roles:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1], (*lines, f"{role}:{text}")))
    return min(ends, key=lambda e: e[:2])


def expected(rows, solve=True):
    out = {}
    for conv, mine in hurt(rows).items():
        kinds = faults(mine)
        turns = {t for t, *_ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        numbers = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal)
        if len(mine) > 9:
            out[conv] = numbers
            continue
        cost, audit, lines = cheapest(mine, kinds)
        out[conv] = (*numbers, cost, audit, brute.sha("\n".join(lines)))
    return out


def told(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_conversation_repair(spark, corpus):
    table = spark.read.parquet(f"{corpus[0]}/conversations.parquet")
    df = QUERIES["op11_conversation_repair"](spark, corpus[0])
    got = told(df)
    want = expected([r.asDict() for r in table.collect()])
    assert got.keys() == want.keys() and df.count() == len(want)
    for conv, w in want.items():
        assert got[conv][: len(w)] == w, conv
    assert sum(len(w) == 8 for w in want.values()) > 150


@pytest.mark.parametrize("long_rows", [0, 1, 4])
def test_long_conversations_in_blocks(spark, corpus, long_rows):
    """Every conversation over ``long_rows`` rows goes block by block; results are the same."""
    table = repair_module.damaged(spark.read.parquet(f"{corpus[0]}/conversations.parquet"))
    whole = told(repair_module.repair(table, copies="_stands"))
    if long_rows:
        blocks = told(repair_module.repair(table, copies="_stands", long_rows=long_rows))
    else:  # by bytes
        blocks = told(repair_module.repair(table, copies="_stands", long_bytes=20))
    assert blocks == whole


def test_one_very_long_conversation(spark):
    rows = spark.range(30_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").when(F.col("id") % 7 == 1, "tool").otherwise("assistant").alias("role"),
        F.when(F.col("id") % 3 == 0, F.lit("Same.")).otherwise(F.concat(F.col("id").cast("string"), F.lit("!"))).alias("text"),
    )
    (r,) = repair_module.repair(rows, long_rows=512).collect()
    (w,) = repair_module.repair(rows, long_rows=100_000).collect()
    assert r == w and r["duplicate"] > 9000


def test_repair_weights_by_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        rows = [(i, rng.choice(("user", "assistant", "system", "tool", " ")), rng.choice(("Yes.", "no", "", f"{i}."))) for i in range(rng.randrange(6))]
        kinds = faults(rows)
        number = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
        items = [(r[1][:1], number[k], 1) for r, k in zip(rows, kinds, strict=True)]
        want = cheapest(rows, kinds)[:2]
        assert repair_module.best(items) == want
        for size in (1, 2):
            cost, parts = repair_module.joined(repair_module.between(items[i : i + size]) for i in range(0, len(items), size))
            assert (cost, "".join(parts)) == want


# ---- spelling ----------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words: dict[str, int]) -> set[tuple]:
    forms, out = {}, set()
    for w, n in words.items():
        near = sorted((-m, o) for o, m in words.items() if one_edit(w, o))
        good = bool(near) and -near[0][0] >= 5 * n
        forms[w] = near[0][1] if good else None
        out.add((w, forms[w], n, len(near), -near[0][0] if good else None))

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {(w, f, root(w), n, k, m) for w, f, n, k, m in out}


def test_acceptor_is_minimal_and_pairs_are_all():
    rng = random.Random(4)
    for _ in range(200):
        words = sorted({"".join(rng.choices("abc", k=rng.randrange(7))) for _ in range(rng.randrange(1, 30))})
        a = spelling.Acceptor(words)
        pairs = Counter(tuple(sorted(p)) for p in a.near_pairs())
        assert pairs == Counter((x, y) for i, x in enumerate(words) for y in words[i + 1 :] if one_edit(x, y))
        live, open_ = set(), [0]
        while open_:
            s = open_.pop()
            if s not in live:
                live.add(s)
                open_ += a.arcs[s].values()
        rests = {w[i:]: None for w in words for i in range(len(w) + 1)}
        starts = {w[:i] for w in words for i in range(len(w) + 1)}
        assert len(live) == len({frozenset(r for r in rests if p + r in words) for p in starts})


@pytest.mark.parametrize("most", [20_000, 2])
def test_spelling_variants(spark, most):
    rng = random.Random(6)
    words = {"".join(rng.choices("abÿ", k=rng.randrange(1, 9))): rng.choice((5, 6, 30, 200, 1500)) for _ in range(160)}
    words |= {"b" * 3000: 7, "b" * 3001: 40, "b" * 1500 + "a" + "b" * 1500: 300}
    df = spark.createDataFrame(sorted(words.items()), "word string, n long").repartition(3)
    got = spelling.variants(df, most=most).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == grouped(words) and len(got) == len(words)


def test_spelling_query(spark, corpus):
    counts = Counter()
    for d in corpus[1]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", d["text"] or ""):
            run = brute.lowered(run)
            h = zlib.crc32(f"{d['doc_id'] if d['doc_id'] is not None else ''}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = grouped({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    got = QUERIES["op12_spelling"](spark, corpus[0]).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 50


# ---- WARC --------------------------------------------------------------------------------


def test_archives_round_trip(spark, corpus):
    pages = spark.read.parquet(f"{corpus[0]}/pages.parquet")
    t = RoundTables(spark, "warc-test")
    path = t.path("archives")
    warc.write_archives(pages, path, piece_bytes=2000, file_pieces=2)
    rows = {r["page_id"]: r for r in pages.collect()}
    largest = {}
    for k, r in rows.items():
        largest[r["html"] or ""] = max(k, largest.get(r["html"] or "", k))
    got = {}
    files = spark.read.format("binaryFile").load(path).collect()
    for f in files:
        assert len(f["content"]) < 2 * (2000 + 12_000)
        for at, length, fields, http, payload in warc.records(f["content"]):
            key = int(fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">"))
            got[key] = fields["warc-type"], bytes(payload), int(http["content-length"])
            assert f["content"][at : at + 8] == b"WARC/1.1" and f["content"][at + length :].startswith(b"\r\n\r\n")
    assert len(files) > 4 and got.keys() == rows.keys()
    for k, r in rows.items():
        body = (r["html"] or "").encode()
        again = len(body) >= 1000 and largest[r["html"]] != k
        assert got[k] == ("revisit" if again else "response", b"" if again else body, len(body))
    t.drop()


def test_histories_are_in_global_order(spark, corpus):
    pages = spark.read.parquet(f"{corpus[0]}/pages.parquet").repartition(5)
    t = RoundTables(spark, "warc-test")
    warc.write_archives(pages, t.path("archives"), piece_bytes=2000, file_pieces=2)
    runs = warc.read_runs(spark, t.path("archives"))
    index = warc.histories(runs, pages.count(), range_rows=10)
    parts = index.select(*warc.ORDER, F.spark_partition_id().alias("part")).collect()
    places = [tuple(r)[:4] for r in parts]
    assert places == sorted(places) and len(set(places)) == pages.count()
    hot = {r["part"] for r in parts if r["url_key"] == "example,hot)/"}
    assert len(hot) > 1, "one URL's captures are cut too"
    t.drop()


def test_loser_tree():
    rng = random.Random(8)
    for _ in range(200):
        runs = [sorted((rng.choice("ab"), rng.choice("cd"), str(i), j, "x") for j in range(rng.randrange(7))) for i in range(rng.randrange(9))]
        assert list(warc.merged(runs)) == sorted(e for r in runs for e in r)


def test_url_keys():
    assert warc.url_key("https://www.A.example.com:443/P?q=1#top") == warc.url_key("http://a.example.com/p?q=1")
    assert warc.url_key("http://a.b:8080") == "b,a:8080)/" and warc.url_key(None) == ""


def test_bytes_and_repeated_pages(spark):
    body = bytes(range(256)) * 8
    rows = [(1, "u", body), (2, "u", body), (2, "v", body), (None, "u", body), (None, "u", None)]
    got = warc.op13_warc(spark.createDataFrame(rows, "page_id long, url string, html binary")).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == Counter(
        [(1, "revisit", 2, 2048), (2, "response", None, 2048), (2, "response", None, 2048), (None, "revisit", 2, 2048), (None, "response", None, 0)]
    )
