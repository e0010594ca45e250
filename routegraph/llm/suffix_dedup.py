"""Suffix-array deduplication by distributed prefix doubling, on sampled positions first.

Prefix doubling ranks the positions of all texts by their first bytes, again by pairs of
ranks at growing offsets, and drops a position as soon as its rank is unique. Ranking every
byte position in Spark moves many times the corpus in every round, so the rounds run on
fewer positions until little is left (see the README for figures):

1. *anchors* (24 bytes): every ``LENGTH``-byte string is ranked by one of its 24-byte
   grams, the one with the smallest hash, so about one position in 14 stands for all.
   Strings whose anchor occurs in one document only are unique and go.
2. *cells*: the strings that share an anchor place lie in one stretch of text, their cell.
   Cells are ranked by their whole bytes: of equal cells only the one in the smallest
   document goes on, the strings of the others are found.
3. *doubling*: the strings of the cells that are left meet by anchor. They are ranked by 25
   bytes, unique ones go, and by the pair of ranks at offset 0 and 25. The strings of very
   frequent anchors meet by their own hash, which spreads them.

Texts are dealt to chunks by a hash; all rounds and the cut read the same exchange. Only
packed arrays travel: hashes, cells' bytes, and one bit per cell or string as the answer.

Defined results: a null text is an empty text; texts shorter than ``LENGTH`` lose nothing;
rows with the same key never remove from each other; a null key counts as larger than all
others; an empty table gives no rows. Anchors, cells and frequent strings go by 64-bit
hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegraph.llm.packed import _MIX, _powers, bucket_of, buckets_for, grouped, mix, pack, rows_of, split, text_bytes, unpack

LENGTH = 50
GRAM = 24
#: Chunks of text that hold an anchor for it to count as frequent: decides its route only.
FREQUENT = 64
CHUNK_BYTES = 8 << 20
PASS_BYTES = 1 << 19
NO_KEY = np.iinfo(np.int64).max
_RAW_MIX = _MIX.copy()
_RAW_MIX[65:91] = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 26, dtype=np.uint64)

BLOB = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary())])
BLOB_DDL = "bucket int, chunk int, data binary"


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a number."""
    return np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from every position."""
    e = eights(data)
    n = len(data) - GRAM + 1
    h = mix(e[:n] * np.uint64(0x9E3779B97F4A7C15))
    for at in range(8, GRAM, 8):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + e[at : at + n])
    return h


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` places the place of the smallest hash, the first of equal ones."""
    x = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    if done < width:
        x = np.minimum(x[: len(x) - (width - done)], x[width - done :])
    return (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Cells:
    """The cells of some texts: per cell its text, first string, number of strings, anchor
    hash and the hash of its bytes."""

    def __init__(self, texts: list[bytes]) -> None:
        parts = [c for p in _passes(texts) for c in self._of(*p)]
        names = ("text", "first", "n", "anchor", "cell")
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
            setattr(self, name, np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind))

    @staticmethod
    def _of(data: np.ndarray, owner: np.ndarray, begins: np.ndarray, shift: np.ndarray) -> Iterator[tuple]:
        """data: texts (or parts) end to end; owner, begins, shift: per part its text, its
        start in the data and its start in the text."""
        if len(data) < LENGTH:
            return
        h = gram_hashes(data)
        anchor = smallest(h, LENGTH - GRAM + 1)
        part = np.searchsorted(begins, np.arange(len(anchor)), "right") - 1
        inside = np.arange(len(anchor)) + LENGTH <= np.append(begins[1:], len(data))[part]
        p = np.flatnonzero(inside)
        if not len(p):
            return
        a, part = anchor[p], part[p]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])]))
        n = np.diff(np.append(new, len(p)))
        first, part = p[new], part[new]
        up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RAW_MIX[data] * up[: len(data)], out=total[1:])
        ends = first + n - 1 + LENGTH
        cell = mix((total[ends] - total[first]) * down[first] + (ends - first).astype(np.uint64))
        yield owner[part], first - begins[part] + shift[part], n, h[a[new]], cell


def _passes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts end to end, about PASS_BYTES at once; longer ones in overlapping parts."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def ready() -> tuple:
        data = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
        begins = np.cumsum([0] + [len(h[2]) for h in held[:-1]])
        return data, np.array([h[0] for h in held]), begins, np.array([h[1] for h in held])

    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), PASS_BYTES):
            part = t[at : at + PASS_BYTES + LENGTH - 1]
            if held and size + len(part) > 2 * PASS_BYTES:
                yield ready()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield ready()


def _texts(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    keys = table.column("_key").fill_null(NO_KEY).to_numpy()
    return keys, [t or b"" for t in table.column("_text").cast(pa.binary()).to_pylist()]


class Repeated:
    """A chunk's cells with anchors that several documents have, one entry per distinct cell."""

    def __init__(self, keys: np.ndarray, texts: list[bytes], answers: list[dict[str, np.ndarray]]) -> None:
        c = self.all = Cells(texts)
        known = np.concatenate([_wide(a) for a in answers]) if answers else np.zeros(0, np.uint64)
        frequent = np.concatenate([a["frequent"] for a in answers]) if answers else np.zeros(0, bool)
        order = np.argsort(known)
        known, frequent = known[order], frequent[order]
        short = c.anchor >> np.uint64(16)
        at = np.minimum(np.searchsorted(known, short), max(len(known) - 1, 0))
        hit = known[at] == short if len(known) else np.zeros(len(short), bool)
        self.rows = np.flatnonzero(hit)
        self.key = keys[c.text[self.rows]]
        # smallest document of each distinct cell
        order = np.lexsort((self.key, c.cell[self.rows]))
        cell = c.cell[self.rows][order]
        head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else order
        self.cell = cell[head]
        self.own = np.searchsorted(self.cell, c.cell[self.rows])
        first = self.rows[order[head]]
        self.low = self.key[order[head]]
        self.text, self.first, self.n = c.text[first], c.first[first], c.n[first]
        self.anchor, self.frequent = c.anchor[first], frequent[at[first]] if len(first) else np.zeros(0, bool)

    def beaten(self, n_buckets: int, answers: dict[int, np.ndarray]) -> np.ndarray:
        """For every distinct cell whether a smaller document of another chunk has it."""
        out = np.zeros(len(self.cell), bool)
        for b, (rows,) in split(bucket_of(self.cell, n_buckets), n_buckets, np.arange(len(self.cell))):
            out[rows] = answers[b]
        return out

    def strings(self, texts: list[bytes], cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the cells end to end, their lengths)."""
        parts = [texts[t][f : f + n - 1 + LENGTH] for t, f, n in zip(self.text[cells].tolist(), self.first[cells].tolist(), self.n[cells].tolist(), strict=True)]
        return np.frombuffer(b"".join(parts), np.uint8), self.n[cells] - 1 + LENGTH


def _wide(a: dict[str, np.ndarray]) -> np.ndarray:
    return (a["high"].astype(np.uint64) << np.uint64(16)) | a["low"]


def anchors(texts: DataFrame, n_buckets: int, frequent: int) -> DataFrame:
    def send(table: pa.Table) -> Iterator[tuple]:
        own = table.column("_chunk")[0].as_py()
        keys, t = _texts(table)
        c = Cells(t)
        if not len(c.anchor):  # no text of the chunk is as long as a string
            return
        a, key = c.anchor >> np.uint64(16), keys[c.text]
        order = np.lexsort((key, a))
        a, key = a[order], key[order]
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        tail = np.append(head[1:], len(a)) - 1
        several = key[head] != key[tail]
        a = a[head]
        for b, (x, s) in split(bucket_of(a << np.uint64(16), n_buckets), n_buckets, a, several):
            yield b, own, pack(high=(x >> np.uint64(16)).astype(np.uint32), low=x.astype(np.uint16), several=s)

    def judge(table: pa.Table) -> Iterator[tuple]:
        own = table.column("bucket")[0].as_py()
        sent = [unpack(d) for d in table.column("data").to_pylist()]
        x, at, n = np.unique(np.concatenate([_wide(s) for s in sent]), return_inverse=True, return_counts=True)
        more = (n > 1) | (np.bincount(at, np.concatenate([s["several"] for s in sent])) > 0)
        ends = np.cumsum([len(s["low"]) for s in sent])
        for chunk, s, end in zip(table.column("chunk").to_pylist(), sent, ends, strict=True):
            mine = at[end - len(s["low"]) : end]
            keep = more[mine]
            if keep.any():
                yield own, chunk, pack(high=s["high"][keep], low=s["low"][keep], frequent=n[mine[keep]] >= frequent)

    sent = grouped(texts, "_chunk", send, BLOB, BLOB_DDL)
    return grouped(sent, "bucket", judge, BLOB, BLOB_DDL)


def with_answers(texts: DataFrame, answers: DataFrame, fn, schema: pa.Schema, ddl: str) -> DataFrame:
    """``fn`` on each chunk's keys, texts and the answers (kind, bucket, data) for it."""

    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        keys, t = _texts(left)
        told: dict[int, dict[int, dict[str, np.ndarray]]] = {k: {} for k in range(4)}
        for kind, bucket, data in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "data")), strict=True):
            told[kind][bucket] = unpack(data)
        rows = list(fn(left.column("_chunk")[0].as_py(), keys, t, told))
        return pa.Table.from_batches([rows_of(rows, schema)], schema=schema)

    return texts.groupBy("_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(call, ddl)


def cell_ranks(texts: DataFrame, found: DataFrame, n_buckets: int) -> DataFrame:
    def send(chunk: int, keys: np.ndarray, t: list[bytes], told: dict) -> Iterator[tuple]:
        r = Repeated(keys, t, list(told[0].values()))
        for b, (cell, low) in split(bucket_of(r.cell, n_buckets), n_buckets, r.cell, r.low):
            yield b, chunk, pack(cell=cell, low=low)

    def judge(table: pa.Table) -> Iterator[tuple]:
        own = table.column("bucket")[0].as_py()
        sent = [unpack(d) for d in table.column("data").to_pylist()]
        cells, at = np.unique(np.concatenate([s["cell"] for s in sent]), return_inverse=True)
        low = np.concatenate([s["low"] for s in sent])
        least = np.full(len(cells), NO_KEY)
        np.minimum.at(least, at, low)
        beaten, ends = low > least[at], np.cumsum([len(s["cell"]) for s in sent])
        for chunk, s, end in zip(table.column("chunk").to_pylist(), sent, ends, strict=True):
            yield own, chunk, pack(beaten=beaten[end - len(s["cell"]) : end])

    sent = with_answers(texts, found, send, BLOB, BLOB_DDL)
    return grouped(sent, "bucket", judge, BLOB, BLOB_DDL)


def string_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    e = eights(data)
    h = mix(e[starts] * np.uint64(0x9E3779B97F4A7C15))
    for at in (8, 16, 24, 32, 40, LENGTH - 8):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + e[starts + at])
    return h


def string_starts(lengths: np.ndarray) -> np.ndarray:
    """Where the strings of cells that lie end to end start."""
    n = lengths - LENGTH + 1
    return np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(n) - n), n) + np.arange(n.sum())


def sent_strings(r: Repeated, t: list[bytes], beaten: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, cells, none) of the cells that go on, and the frequent ones as (n_buckets,
    cells, strings' hashes)."""
    on = np.flatnonzero(~beaten)
    plain = on[~r.frequent[on]]
    for b, (cells,) in split(bucket_of(r.anchor[plain], n_buckets), n_buckets, plain):
        yield b, cells, np.zeros(0, np.uint64)
    often = on[r.frequent[on]]
    if len(often):
        data, lengths = r.strings(t, often)
        yield n_buckets, often, string_hashes(data, string_starts(lengths))


def frequent_strings(r: Repeated, cells: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, smallest key of each, number of the hash for every string)."""
    key = np.repeat(r.low[cells], r.n[cells])
    distinct, at = np.unique(hashes, return_inverse=True)
    low = np.full(len(distinct), NO_KEY)
    np.minimum.at(low, at, key)
    return distinct, low, at


def doubled(data: np.ndarray, starts: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For the LENGTH-byte strings at ``starts`` whether a smaller key has the same string.

    Ranks by half the length, then by the pair of ranks at offset 0 and half; a string
    whose half is held by one key only is settled after the first ranking.
    """
    half = LENGTH // 2
    e = eights(data)
    places = np.unique(np.concatenate([starts, starts + half]))
    h = mix(e[places] * np.uint64(0x9E3779B97F4A7C15))
    for at in (8, 16, half - 8):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + e[places + at])
    rank_of_place = np.unique(h, return_inverse=True)[1]
    a = rank_of_place[np.searchsorted(places, starts)]
    b = rank_of_place[np.searchsorted(places, starts + half)]
    out = np.zeros(len(starts), bool)
    low, high = np.full(rank_of_place.max() + 1, NO_KEY), np.full(rank_of_place.max() + 1, -1)
    np.minimum.at(low, a, key)
    np.maximum.at(high, a, key)
    on = np.flatnonzero(low[a] != high[a])
    if len(on):
        pair, at = np.unique(a[on].astype(np.uint64) << np.uint64(32) | b[on].astype(np.uint64), return_inverse=True)
        least = np.full(len(pair), NO_KEY)
        np.minimum.at(least, at, key[on])
        out[on] = key[on] > least[at]
    return out


STRINGS = pa.schema([*BLOB, ("whole", pa.bool_())])


def string_ranks(texts: DataFrame, found: DataFrame, n_buckets: int) -> DataFrame:
    def send(chunk: int, keys: np.ndarray, t: list[bytes], told: dict) -> Iterator[tuple]:
        r = Repeated(keys, t, list(told[0].values()))
        beaten = r.beaten(n_buckets, {b: a["beaten"] for b, a in told[1].items()})
        for b, cells, hashes in sent_strings(r, t, beaten, n_buckets):
            if b < n_buckets:
                data, lengths = r.strings(t, cells)
                yield b, chunk, pack(data=data, length=lengths.astype(np.uint16), low=r.low[cells]), True
            else:
                distinct, low, _ = frequent_strings(r, cells, hashes)
                for fb, (x, k) in split(bucket_of(distinct, n_buckets), n_buckets, distinct, low):
                    yield fb, chunk, pack(hash=x, low=k), False

    def judge(table: pa.Table) -> Iterator[tuple]:
        own, whole = table.column("bucket")[0].as_py(), np.array(table.column("whole").to_pylist(), bool)
        chunks, sent = table.column("chunk").to_pylist(), [unpack(d) for d in table.column("data").to_pylist()]
        mine = [s for s, w in zip(sent, whole, strict=True) if w]
        if mine:
            lengths = np.concatenate([s["length"] for s in mine]).astype(np.int64)
            key = np.repeat(np.concatenate([s["low"] for s in mine]), lengths - LENGTH + 1)
            dup = doubled(np.concatenate([s["data"] for s in mine]), string_starts(lengths), key)
            sizes = [int((s["length"].astype(np.int64) - LENGTH + 1).sum()) for s in mine]
            at = 0
            for chunk, n in zip([c for c, w in zip(chunks, whole, strict=True) if w], sizes, strict=True):
                yield own, chunk, pack(dup=dup[at : at + n]), True
                at += n
        often = [(c, s) for c, s, w in zip(chunks, sent, whole, strict=True) if not w]
        if often:
            x, at = np.unique(np.concatenate([s["hash"] for _, s in often]), return_inverse=True)
            low = np.concatenate([s["low"] for _, s in often])
            least = np.full(len(x), NO_KEY)
            np.minimum.at(least, at, low)
            first = 0
            for chunk, s in often:
                n = len(s["hash"])
                yield own, chunk, pack(least=least[at[first : first + n]]), False
                first += n

    sent = with_answers(texts, found, send, STRINGS, BLOB_DDL + ", whole boolean")
    return grouped(sent, "bucket", judge, STRINGS, BLOB_DDL + ", whole boolean")


RESULT = pa.schema([
    ("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()),
])


def removed(r: Repeated, t: list[bytes], told: dict, n_buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, start, end) of the removed runs of the texts that lose any."""
    beaten = r.beaten(n_buckets, {b: a["beaten"] for b, a in told[1].items()})
    first_bit = np.full(len(r.cell), -1)
    bits, total = [], 0
    for b, cells, hashes in sent_strings(r, t, beaten, n_buckets):
        if b < n_buckets:
            dup = told[2][b]["dup"]
        else:
            distinct, low, at = frequent_strings(r, cells, hashes)
            least = np.empty(len(distinct), np.int64)
            for fb, (rows,) in split(bucket_of(distinct, n_buckets), n_buckets, np.arange(len(distinct))):
                least[rows] = told[3][fb]["least"]
            dup = np.repeat(r.low[cells], r.n[cells]) > least[at]
        n = r.n[cells]
        first_bit[cells] = total + np.cumsum(n) - n
        bits.append(dup)
        total += len(dup)
    bit = np.concatenate(bits) if bits else np.zeros(0, bool)
    c = r.all
    row, own = r.rows, r.own
    n = c.n[row]
    string = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cell = np.repeat(own, n)
    found = np.repeat((r.key > r.low[own]) | beaten[own], n)
    asked = ~found
    found[asked] = bit[first_bit[cell[asked]] + string[asked]]
    text = np.repeat(c.text[row], n)[found]
    start = (np.repeat(c.first[row], n) + string)[found]
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    if not len(text):
        return
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] > start[:-1] + LENGTH)])
    heads = np.flatnonzero(new)
    ends = start[np.append(heads[1:], len(start)) - 1] + LENGTH
    at = np.flatnonzero(np.concatenate([[True], np.diff(text[heads]) != 0]))
    for lo, hi in zip(at, np.append(at[1:], len(heads)), strict=True):
        yield int(text[heads[lo]]), start[heads[lo:hi]], ends[lo:hi]


def cut_texts(texts: DataFrame, found: DataFrame, n_buckets: int) -> DataFrame:
    def cut(chunk: int, keys: np.ndarray, t: list[bytes], told: dict) -> Iterator[tuple]:
        r = Repeated(keys, t, list(told[0].values()))
        runs = {i: (s, e) for i, s, e in removed(r, t, told, n_buckets)}
        for i, (key, text) in enumerate(zip(keys.tolist(), t, strict=True)):
            starts, ends = runs.get(i, (np.zeros(0, int), np.zeros(0, int)))
            kept, at = [], 0
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                kept.append(text[at:s])
                at = e
            kept.append(text[at:])
            yield None if key == NO_KEY else key, len(text), int((ends - starts).sum()), len(starts), b"".join(kept)

    return with_answers(texts, found, cut, RESULT, "key long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeats_removed(docs: DataFrame, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) for every row; ``kept`` are the bytes left."""
    size = text_bytes(docs, text)
    n_buckets = buckets_for(docs, size)
    n_chunks = buckets_for(docs, size, CHUNK_BYTES)
    body = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    texts = body.withColumn("_chunk", F.pmod(F.xxhash64("_key", F.crc32(F.encode("_text", "UTF-8"))), F.lit(n_chunks)).cast("int"))
    texts = texts.select("_chunk", "_key", "_text")

    def kind(df: DataFrame, k) -> DataFrame:
        return df.select("bucket", "chunk", "data", k.cast("int").alias("kind"))

    held = kind(anchors(texts, n_buckets, frequent), F.lit(0))
    told = held.unionByName(kind(cell_ranks(texts, held, n_buckets), F.lit(1)))
    strings = string_ranks(texts, told, n_buckets)
    told = told.unionByName(kind(strings, F.when(F.col("whole"), 2).otherwise(3)))
    return cut_texts(texts, told, n_buckets).select(
        F.col("key").alias(key), "n_bytes", "n_removed", "n_spans", "kept"
    )


def op9_suffix_dedup(docs: DataFrame) -> DataFrame:
    return repeats_removed(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
