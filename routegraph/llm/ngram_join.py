"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections.

The set of a text is its distinct ``SHINGLE``-word grams. Texts with equal sets form one
class; links are found between classes.

Tiles need not cover every pair of classes. Two sets with Jaccard similarity of at least
3/4 share at least 3/4 of either set, so

* a class is a candidate only if enough of its grams occur in another class: first on the
  two fifths of all grams with the smallest hashes, then on all grams of what is left;
* ordered by frequency among the candidates, two linked sets share one of their
  ``n - ceil(3n/4) + 1`` rarest grams. Chains through classes that share such a gram, in
  the order of their sizes, connect all linked classes; the connected groups are small.

Any order of the grams will do for that, if it is the same for all classes. So grams that many
documents of a sample have, in more than one class, are not counted at all: they come last, in
the order of their hashes, and stay with their chunk of documents. A chunk also chains its own
classes and sends on only the ends of the chains, so a passage in any share of the documents
gives a bucket a few entries per chunk.

Each group is cut into bands by set size (a band spans a factor of 4/3, so links stay in a
band or reach the next one) and bands into tiles of about ``TILE`` classes. For a pair of
tiles, bitmap signatures bound every overlap from above: each bit in which two signatures
differ stands for a gram that only one set has. Pairs that can still reach the threshold
get the exact intersection of their sorted gram arrays. A pair of tiles returns link
counts and a spanning forest, not its pairs.

Defined results: texts without words have an empty set, are linked with nothing and are
their own component; texts with fewer than ``SHINGLE`` words have one gram, all their
words; rows with equal texts are linked; a null key joins groups but never names one that
has another key; an empty table gives no rows. Keys are integers.
Grams and classes go by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegraph.llm.common import Scratch, text_or_empty, written
from routegraph.llm.links import roots, stars
from routegraph.llm.packed import (
    bucket_of, buckets_for, doc_chunks, grouped, mix, pack, rows_of, split, text_bytes, unpack, word_hashes,
)

SHINGLE = 5
#: Similarity of 3/4: 7 * overlap >= 3 * (size + size).
TILE = 256
#: Share of the grams that the first round of filtering looks at.
SAMPLE = 0.4
SIGNATURE_WORDS = 8
#: Text that a task handles at once, and text behind one bucket of grams.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Documents of the sample (one in SAMPLE_OF) that have a gram which is not counted, as a share of
#: them and at least. There are no more such grams than a document has on average, times 1 / share.
SAMPLE_OF, HOT_SHARE, HOT_LEAST = 64, 1 / 4096, 8
#: Groups of more than a tile, a few hundred bytes each, that a broadcast may hold.
BROADCAST_ROWS = 100_000

ROWS = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("cls", pa.int64())])
BLOB = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("about", pa.bool_()), ("data", pa.binary())])
BLOB_DDL = "bucket int, chunk long, about boolean, data binary"


def gram_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the grams, text by text and sorted; set sizes; class ids, 0 for empty sets)."""
    words, sizes = word_hashes(texts)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    m = max(len(words) - SHINGLE + 1, 0)
    grams = np.full(m, 0x1234567, np.uint64)
    for i in range(SHINGLE):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m])
    sets = []
    for lo, n in zip(begins.tolist(), sizes.tolist(), strict=True):
        if n >= SHINGLE:
            sets.append(np.unique(grams[lo : lo + n - SHINGLE + 1]))
        elif n:
            h = np.uint64(n)
            for w in words[lo : lo + n]:
                h = mix(np.array([h], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + w)[0]
            sets.append(np.array([h], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    cls = np.zeros(len(sets), np.uint64)
    np.add.at(cls, owner, mix(flat + np.uint64(0x51ED270B)))
    cls = np.where(n > 0, mix(cls + n.astype(np.uint64)) | np.uint64(1), np.uint64(0))
    return flat, n, cls


def _sampled(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many of the ``m`` grams looked at must occur elsewhere, of a set of ``n``."""
    return m - n // 4


def class_rows(docs: DataFrame) -> DataFrame:
    """(key, hash, n, cls) of rows (_key, _hash, _text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (keys, hashes), texts in doc_chunks(batches, CHUNK_BYTES):
            _, n, cls = gram_sets(texts)
            yield pa.RecordBatch.from_arrays([keys, hashes, pa.array(n), pa.array(cls.view(np.int64))], schema=ROWS)

    return docs.mapInArrow(scan, "key long, hash long, n long, cls long")


def common_grams(docs: DataFrame, rows: int) -> np.ndarray:
    """Sorted grams of more than one class that many documents of a sample of ``docs`` have.

    They decide only the order of grams and where entries go.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in doc_chunks(batches, CHUNK_BYTES):
            flat, n, cls = gram_sets(texts)
            owner = np.repeat(cls, n)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(owner.view(np.int64))], names=["gram", "cls"])

    sample = docs.filter(F.pmod(F.xxhash64("_key", "_hash"), F.lit(SAMPLE_OF)) == 0).select("_text")
    counts = sample.mapInArrow(scan, "gram long, cls long").groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("cls").alias("low"), F.max("cls").alias("high")
    )
    least = max(HOT_LEAST, int(HOT_SHARE * rows / SAMPLE_OF))
    hot = counts.filter((F.col("n") >= least) & (F.col("low") != F.col("high"))).select("gram").toArrow()
    return np.unique(hot.column(0).to_numpy().view(np.uint64))


def gram_blobs(docs: DataFrame, n_buckets: int, share: float, hot: np.ndarray) -> DataFrame:
    """Each chunk's classes with their ``hot`` grams, and per bucket their other grams; of all, the
    grams with hashes in the lowest ``share``."""
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts in doc_chunks(batches, CHUNK_BYTES):
            flat, n, cls = gram_sets(texts)
            once = np.zeros(len(cls), bool)
            once[np.unique(cls, return_index=True)[1]] = True
            once &= cls != 0
            owner = np.repeat(np.arange(len(n)), n)
            keep = once[owner] & (flat <= limit)
            number = np.cumsum(once) - 1
            flat, owner = flat[keep], number[owner[keep]].astype(np.uint16)
            looked = np.bincount(owner, minlength=int(once.sum()))
            at = np.minimum(np.searchsorted(hot, flat), max(len(hot) - 1, 0))
            often = hot[at] == flat if len(hot) else np.zeros(len(flat), bool)
            about = pack(cls=cls[once], n=n[once], looked=looked, hot=flat[often], hot_doc=owner[often])
            flat, owner = flat[~often], owner[~often]
            rows = [(chunk % n_buckets, chunk, True, about)]
            for b, (grams, doc) in split(bucket_of(flat, n_buckets), n_buckets, flat, owner):
                order = np.argsort(grams)
                grams, doc = grams[order], doc[order]
                there, at = np.unique(doc, return_inverse=True)
                rows.append((b, chunk, False, pack(
                    high=(grams >> np.uint64(32)).astype(np.uint32), low=grams.astype(np.uint32),
                    doc=at.astype(np.uint16), there=there, cls=cls[once][there],
                )))
            yield rows_of(rows, BLOB)

    return docs.select("_text").mapInArrow(scan, BLOB_DDL)


def _frequencies(parts: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, part number, number of classes that have it) for all entries of ``parts``."""
    gram = np.concatenate([(p["high"].astype(np.uint64) << np.uint64(32)) | p["low"] for p in parts])
    cls = np.concatenate([p["cls"][p["doc"]] for p in parts])
    part = np.repeat(np.arange(len(parts)), [len(p["doc"]) for p in parts])
    order = np.lexsort((cls, gram))
    g, c = gram[order], cls[order]
    new_gram = np.concatenate([[True], g[1:] != g[:-1]])
    new_class = new_gram | np.concatenate([[True], c[1:] != c[:-1]])
    run = np.cumsum(new_gram) - 1
    df = np.empty(len(gram), np.int64)
    df[order] = np.bincount(run, new_class).astype(np.int64)[run]
    return gram, part, df


def shared_counts(blobs: DataFrame) -> DataFrame:
    """(cls): the classes with enough grams, of those looked at, that other classes have."""

    def count(table: pa.Table) -> Iterator[tuple]:
        chunks, parts = [], []
        for chunk, about, data in zip(*(table.column(c).to_pylist() for c in ("chunk", "about", "data")), strict=True):
            if about:
                yield 0, chunk, True, data
            else:
                chunks.append(chunk)
                parts.append(unpack(data))
        if not parts:
            return
        _, part, df = _frequencies(parts)
        ends = np.cumsum(np.bincount(part, minlength=len(parts)))
        for i, (chunk, p) in enumerate(zip(chunks, parts, strict=True)):
            mine = p["doc"][df[ends[i] - len(p["doc"]) : ends[i]] > 1]
            n = np.bincount(mine, minlength=len(p["there"]))
            some = np.flatnonzero(n)
            if len(some):
                yield 0, chunk, False, pack(doc=p["there"][some], n=n[some].astype(np.uint32))

    def decide(table: pa.Table) -> Iterator[tuple]:
        about, parts = None, []
        for a, data in zip(table.column("about").to_pylist(), table.column("data").to_pylist(), strict=True):
            if a:
                about = unpack(data)
            else:
                parts.append(unpack(data))
        shared = np.bincount(about["hot_doc"], minlength=len(about["cls"]))
        for p in parts:
            np.add.at(shared, p["doc"], p["n"])
        ok = shared >= _sampled(about["n"], about["looked"])
        yield from zip(about["cls"][ok].view(np.int64).tolist(), strict=True)

    counted = grouped(blobs, "bucket", count, BLOB, BLOB_DDL)
    return grouped(counted, "chunk", decide, pa.schema([("cls", pa.int64())]), "cls long").distinct()


SHARED = pa.schema([("chunk", pa.int64()), ("about", pa.bool_()), ("data", pa.binary())])
KEPT = pa.schema([("bucket", pa.int32()), ("cls", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def candidate_grams(blobs: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, cls, n, data): with bucket -1 a class and its sorted shared grams, with -2 links
    between classes of a chunk, else the chunk's chains by rare gram for that bucket."""

    def tell(table: pa.Table) -> Iterator[tuple]:
        chunks, parts = [], []
        for chunk, about, data in zip(*(table.column(c).to_pylist() for c in ("chunk", "about", "data")), strict=True):
            if about:
                yield chunk, True, data
            else:
                chunks.append(chunk)
                parts.append(unpack(data))
        if not parts:
            return
        gram, part, df = _frequencies(parts)
        ends = np.cumsum(np.bincount(part, minlength=len(parts)))
        for i, (chunk, p) in enumerate(zip(chunks, parts, strict=True)):
            s = slice(ends[i] - len(p["doc"]), ends[i])
            more = df[s] > 1
            if more.any():
                yield chunk, False, pack(gram=gram[s][more], doc=p["there"][p["doc"][more]], df=np.minimum(df[s][more], 2**32 - 1).astype(np.uint32))

    def choose(table: pa.Table) -> Iterator[tuple]:
        about, parts = None, []
        for a, data in zip(table.column("about").to_pylist(), table.column("data").to_pylist(), strict=True):
            if a:
                about = unpack(data)
            else:
                parts.append(unpack(data))
        last = np.full(len(about["hot"]), 2**32 - 1, np.uint32)
        parts.append({"gram": about["hot"], "doc": about["hot_doc"], "df": last})
        gram, doc, df = (np.concatenate([p[k] for p in parts]) for k in ("gram", "doc", "df"))
        if not len(gram):
            return
        n, cls = about["n"], about["cls"]
        shared = np.bincount(doc, minlength=len(n))
        wanted = shared - (n - n // 4) + 1  # rarest grams to take, those that only one class has aside
        order = np.lexsort((gram, df, doc))
        gram, doc = gram[order], doc[order]
        starts = np.cumsum(shared) - shared
        rank = np.arange(len(doc)) - starts[doc]
        for d in np.flatnonzero(wanted > 0).tolist():
            own = np.sort(gram[starts[d] : starts[d] + shared[d]])
            yield -1, int(cls[d].view(np.int64)), int(n[d]), pack(grams=own)
        rare = rank < wanted[doc]
        gram, doc = gram[rare], doc[rare]
        if not len(gram):
            return
        order = np.lexsort((cls[doc], n[doc], gram))
        gram, doc = gram[order], doc[order]
        size, own = n[doc], cls[doc]
        near = (gram[1:] == gram[:-1]) & (4 * size[:-1] >= 3 * size[1:])
        if near.any():
            pairs = np.unique(np.stack([own[1:][near], own[:-1][near]], 1), axis=0)
            yield -2, 0, 0, pack(a=pairs[:, 0], b=pairs[:, 1])
        head = np.flatnonzero(np.concatenate([[True], ~near]))
        tail = np.append(head[1:], len(gram)) - 1
        chained = gram[head], own[head], size[head], size[tail]
        for b, (g, c, low, high) in split(bucket_of(gram[head], n_buckets), n_buckets, *chained):
            yield b, 0, 0, pack(gram=g, cls=c, low=low, high=high)

    told = grouped(blobs, "bucket", tell, SHARED, "chunk long, about boolean, data binary")
    return grouped(told, "chunk", choose, KEPT, "bucket int, cls long, n long, data binary")


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def chains(kept: DataFrame) -> DataFrame:
    """Links (a, b) between classes that are neighbours by size among those with a rare gram.

    Links inside a chunk come as they are. A chunk's chain spans a range of sizes; chains of a
    gram are linked, in the order of their smallest sizes, where the next begins no more than
    4/3 beyond what the ones before have reached: as all their classes would be.
    """

    def chain(table: pa.Table) -> Iterator[tuple]:
        parts = [unpack(d) for d in table.column("data").to_pylist()]
        gram, cls, low, high = (np.concatenate([p[k] for p in parts]) for k in ("gram", "cls", "low", "high"))
        order = np.lexsort((cls, low, gram))
        gram, cls, low, high = gram[order], cls[order].view(np.int64), low[order], high[order]
        number = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
        # the furthest size so far in each gram: later grams start beyond all earlier ones
        _, rank = np.unique(np.concatenate([low, high]), return_inverse=True)
        sizes = np.unique(np.concatenate([low, high]))
        reach = np.maximum.accumulate(number * len(sizes) + rank[len(low) :]) - number * len(sizes)
        near = (gram[1:] == gram[:-1]) & (cls[1:] != cls[:-1]) & (4 * sizes[reach[:-1].clip(0)] >= 3 * low[1:])
        yield from np.unique(np.stack([cls[1:][near], cls[:-1][near]], 1), axis=0).tolist()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                x = unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(x[k].view(np.int64)) for k in "ab"], schema=LINKS)

    own = kept.filter("bucket = -2").select("data").mapInArrow(unpacked, "a long, b long")
    return grouped(kept.filter("bucket >= 0"), "bucket", chain, LINKS, "a long, b long").unionByName(own)


def tile_pairs(members: DataFrame, tile: int) -> DataFrame:
    """(block, side, ...) for rows (cls, n, copies, data, grp): side 0 meets side 1 in a block,
    side 2 is a tile that meets itself."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int")
    sizes = members.withColumn("band", band).groupBy("grp", "band").agg(F.count(F.lit(1)).alias("c"))
    tiles = F.struct("band", F.ceil(F.col("c") / tile).cast("int").alias("tiles"))
    large = written(
        sizes.groupBy("grp")
        .agg(F.sum("c").alias("total"), F.map_from_entries(F.collect_list(tiles)).alias("bands"))
        .filter(F.col("total") > tile),
        "join-groups",
    )
    # members of one group do not have to meet for this: only groups of more than a tile
    # are listed, and their list is broadcast when its counted rows allow it
    listed = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    m = members.withColumn("band", band).join(listed, "grp", "left")
    whole = F.col("total").isNull()
    own = F.pmod(F.xxhash64("cls"), F.element_at("bands", F.col("band"))).cast("int")

    def met(step: int):
        tiles = F.coalesce(F.try_element_at("bands", F.col("band") + step), F.lit(0))
        others = F.filter(F.sequence(F.lit(0), tiles), lambda t: t < tiles)
        mine = F.struct(F.col("band").alias("b"), own.alias("t"))

        def block(t):
            other = F.struct((F.col("band") + step).alias("b"), t.alias("t"))
            name = F.concat_ws("/", F.least(mine, other).cast("string"), F.greatest(mine, other).cast("string"))
            side = F.when(mine == other, 2).when(mine < other, 0).otherwise(1)
            return F.struct(name.alias("name"), side.alias("side"))

        return F.transform(others, block)

    one = F.array(F.struct(F.lit("all").alias("name"), F.lit(2).alias("side")))
    blocks = F.when(whole, one).otherwise(F.concat(met(-1), met(0), met(1)))
    return m.select("grp", "cls", "n", "copies", "data", F.inline(blocks))


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    bits = np.zeros((len(sets), SIGNATURE_WORDS * 64), bool)
    for i, s in enumerate(sets):
        bits[i, (s >> np.uint64(7)) % np.uint64(SIGNATURE_WORDS * 64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def compare(n: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between the sets numbered ``left`` and ``right``."""
    signature, held = _signatures(sets), np.array([len(s) for s in sets])
    a, b = [], []
    for k, i in enumerate(left.tolist()):
        others = right[k + 1 :] if same else right
        need = -(-3 * (n[i] + n[others]) // 7)
        differ = np.bitwise_count(signature[i] ^ signature[others]).sum(1)
        could = others[(held[i] + held[others] - differ >= 2 * need) & (np.minimum(held[i], held[others]) >= need)]
        if not len(could):
            continue
        flat = np.concatenate([sets[j] for j in could])
        at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
        starts = np.cumsum(held[could]) - held[could]
        overlap = np.add.reduceat((sets[i][at] == flat).astype(np.int64), starts)
        linked = could[7 * overlap >= 3 * (n[i] + n[could])]
        a.append(np.full(len(linked), i))
        b.append(linked)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def linked_classes(blocks: DataFrame) -> DataFrame:
    """(cls, links, root): for classes with links in a block, documents linked there and the
    smallest class connected there."""

    def join(table: pa.Table) -> Iterator[tuple]:
        cls, n, copies = (table.column(c).to_numpy() for c in ("cls", "n", "copies"))
        side = table.column("side").to_numpy()
        sets = [unpack(d)["grams"] for d in table.column("data").to_pylist()]
        own = np.flatnonzero(side == 2)
        pairs = [compare(n, sets, own, own, True), compare(n, sets, np.flatnonzero(side == 0), np.flatnonzero(side == 1), False)]
        a, b = np.concatenate([p[0] for p in pairs]).astype(int), np.concatenate([p[1] for p in pairs]).astype(int)
        links = np.bincount(a, copies[b], len(cls)) + np.bincount(b, copies[a], len(cls))
        order = np.argsort(cls)
        place = np.empty(len(cls), int)
        place[order] = np.arange(len(cls))
        top = roots(len(cls), place[a], place[b])
        for i in np.flatnonzero(links > 0).tolist():
            yield int(cls[i]), int(links[i]), int(cls[order[top[place[i]]]])

    schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def call(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([rows_of(list(join(table)), schema)], schema=schema)

    return blocks.groupBy("grp", "name").applyInArrow(call, "cls long, links long, root long")


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", tile: int = TILE, sample: float = SAMPLE) -> DataFrame:
    """(key, n_shingles, component_id, n_links, class_id, text_hash, stays) for every row.

    ``text_hash`` is xxhash64 of the text; ``stays`` marks the row of the smallest key (and
    text hash) of every component, and all rows without grams.
    """
    with Scratch() as scope:
        n_buckets = buckets_for(docs, text_bytes(docs, text), BUCKET_BYTES)
        body = docs.select(
            F.col(key).cast("long").alias("_key"), F.xxhash64(text_or_empty(text)).alias("_hash"), F.col(text).alias("_text")
        )
        rows = written(class_rows(body), "join-rows")
        first = F.struct(F.col("key").isNull().alias("null"), "key", "hash")
        classes = written(
            rows.filter("n > 0").groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min(first).alias("low")), "join-classes"
        )
        hot = common_grams(body, rows.count())
        candidates = written(shared_counts(gram_blobs(body, n_buckets, sample, hot)), "join-candidates")
        wanted = classes.join(candidates, "cls", "left_semi").select(F.col("low.key").alias("_low")).distinct()
        closer = body.join(wanted, F.col("_key").eqNullSafe(F.col("_low")), "left_semi")
        kept = written(candidate_grams(gram_blobs(closer, n_buckets, 1.0, hot), n_buckets), "join-grams")
        groups = stars(chains(kept))

        named = groups.select(F.col("a").alias("cls"), F.col("b").alias("grp"))
        named = written(named.unionByName(groups.select(F.col("b").alias("cls"), F.col("b").alias("grp")).distinct()), "join-named")
        members = (
            kept.filter("bucket = -1").dropDuplicates(["cls"]).select("cls", "n", "data")
            .join(named, "cls").join(classes.select("cls", "copies"), "cls")
        )
        found = written(linked_classes(tile_pairs(written(members, "join-members"), tile)), "join-found")
        tops = stars(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
        node = (
            classes.join(tops.select(F.col("a").alias("cls"), F.col("b").alias("_top")), "cls", "left")
            .join(found.groupBy("cls").agg(F.sum("links").alias("links")), "cls", "left")
            .withColumn("_top", F.coalesce("_top", "cls"))
        )
        node = written(node, "join-nodes")
        lows = written(node.groupBy("_top").agg(F.min("low").alias("component")), "join-lows")
        named_node = written(node.join(lows, "_top").select("cls", "component", "copies", "links"), "join-nodes")
        scope.only(rows, named_node)
    return rows.join(named_node, "cls", "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component.key")).otherwise(F.col("key")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.col("cls").alias("class_id"),
        F.col("hash").alias("text_hash"),
        ((F.col("n") == 0) | (F.col("key").eqNullSafe(F.col("component.key")) & (F.col("hash") == F.col("component.hash")))).alias("stays"),
    )


def op2_ngram_join(docs: DataFrame) -> DataFrame:
    return similar_texts(docs).select("doc_id", "n_shingles", "component_id", "n_links", "class_id")
