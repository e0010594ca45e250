"""Spelling variant grouping by composing finite-state acceptors with a one-edit transducer.

Pairs of words one edit apart are the accepted pairs of A . E . A: the minimised acceptor A
of the vocabulary, the transducer E that copies its input but for one inserted, deleted or
replaced letter, and A again. The composition is spread over partitions of the states that
both acceptors share at the start (and, read backwards, at the end): an edit leaves two
words of ``b`` or ``b + 1`` letters the same first or the same last ``b // 2`` letters, so a
word goes to the partitions of its two halves. A partition with more than ``most`` words is
split again by the halves of what its words do not share yet, until one letter is left: of
such words there are no more than the alphabet gives. A pair is accepted in one partition
only, the first half being preferred at each split.

In a partition the composed states are walked: a state before the edit pairs a state with
itself; an edit leads to a pair of two states, from which both acceptors read the same.
What is accepted from a state is found once however many words lead to it.

Defined results: null texts have no words; an empty table gives no rows; words of any length
are whole; extra columns are ignored; ties between near words go to the least word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegraph.llm.common import CRC32_ENTRIES, ascii_lower, crc32_sql
from routegraph.llm.packed import rows_of
from routegraph.operators.lineage import RoundTables, row_count

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: Words of a partition from which on it is split.
MOST = 20_000


class Acceptor:
    """The minimal deterministic acceptor of sorted distinct words; state 0 is initial."""

    def __init__(self, words: Iterable[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], ""

        def merge(depth: int) -> None:
            """Replace states beyond ``depth`` by known ones that accept the same."""
            while len(path) > depth + 1:
                state = path.pop()
                same = known.setdefault((self.final[state], tuple(self.arcs[state].items())), state)
                self.arcs[path[-1]][last[len(path) - 1]] = same

        for word in words:
            depth = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
            merge(depth)
            for letter in word[depth:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][letter] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = word
        merge(0)

    def common(self, a: int, b: int, barred: str = "") -> list[str]:
        """What both states accept, without what starts with ``barred``."""
        out, open_ = [], [(a, b, None)]
        while open_:
            x, y, path = open_.pop()
            if self.final[x] and self.final[y]:
                out.append(_spelled(path))
            of_x, of_y = self.arcs[x], self.arcs[y]
            if len(of_x) > len(of_y):
                of_x, of_y, swap = of_y, of_x, True
            else:
                swap = False
            for letter, to in of_x.items():
                other = of_y.get(letter)
                if other is not None and (path is not None or letter != barred):
                    open_.append((other, to, (path, letter)) if swap else (to, other, (path, letter)))
        return out

    def edited(self, state: int) -> list[tuple[str, str]]:
        """Pairs accepted from (state, state) whose first letter is edited.

        A deleted letter is the last of a run of it: its pairs would come twice otherwise.
        """
        arcs = list(self.arcs[state].items())
        out = []
        for i, (c, to) in enumerate(arcs):
            out += [(c + rest, rest) for rest in self.common(to, state, c)]
            for d, other in arcs[i + 1 :]:
                out += [(c + rest, d + rest) for rest in self.common(to, other)]
        return out

    def near_pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs of accepted words that one edit tells apart."""
        found: dict[int, list[tuple[str, str]]] = {}
        open_: list[tuple[int, tuple | None]] = [(0, None)]
        while open_:
            state, path = open_.pop()
            if state not in found:
                found[state] = self.edited(state)
            if found[state]:
                start = _spelled(path)
                for x, y in found[state]:
                    yield start + x, start + y
            open_ += [(to, (path, letter)) for letter, to in self.arcs[state].items()]


def _spelled(path: tuple | None) -> str:
    letters = []
    while path is not None:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def accepted_here(x: str, y: str, band: int, way: str) -> bool:
    """Is the partition reached by ``way`` (P: first half, S: last half) the one of a pair?"""
    lead, free = 0, band
    for step in way:
        half = free // 2
        if (x[lead : lead + half] == y[lead : lead + half]) != (step == "P"):
            return False
        lead += half if step == "P" else 0
        free -= half
    return True


def near_in(band: int, way: str, lead: str, tail: str, counts: dict[str, int]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, largest count among them, its word) of the words of a partition."""
    cut = {w[len(lead) : len(w) - len(tail)]: w for w in counts}
    found: dict[str, list] = {}
    for a, b in Acceptor(sorted(cut)).near_pairs():
        x, y = cut[a], cut[b]
        if min(len(x), len(y)) != band or not accepted_here(x, y, band, way):
            continue
        for w, other in ((x, y), (y, x)):
            mine = found.setdefault(w, [0, -1, ""])
            mine[0] += 1
            n = counts[other]
            if n > mine[1] or n == mine[1] and other < mine[2]:
                mine[1:] = n, other
    for w, (n_near, n, other) in found.items():
        yield w, n_near, n, other


_KEY = ["band", "way", "lead", "tail"]


def halves(rows: DataFrame) -> DataFrame:
    """Every row in the partitions of the two halves of what it does not share yet."""
    half = F.floor((F.col("band") - F.length("lead") - F.length("tail")) / 2).cast("int")
    longer_lead = F.left("word", F.length("lead") + F.col("half"))
    longer_tail = F.right("word", F.length("tail") + F.col("half"))
    ways = F.array(
        F.struct(F.concat("way", F.lit("P")).alias("way"), longer_lead.alias("lead"), F.col("tail")),
        F.struct(F.concat("way", F.lit("S")).alias("way"), F.col("lead"), longer_tail.alias("tail")),
    )
    return rows.withColumn("half", half).select("band", "word", "n", F.inline(ways)).select(*_KEY, "word", "n")


def near_words(words: DataFrame, t: RoundTables, most: int = MOST) -> DataFrame:
    """(word, n_near, form_n, form) of words with near words, from (word, n) of distinct words.

    ``form`` is the near word of the largest count; ties go to the least word.
    """
    size = F.length("word")
    none = F.lit("")
    least = words.agg(F.min(size)).first()[0] or 0
    rows = halves(
        words.select(
            F.explode(F.array(size - 1, size)).alias("band"), none.alias("way"), none.alias("lead"), none.alias("tail"), "word", "n"
        ).filter((F.col("band") >= least) & (F.col("band") > 0))
    )
    ready, depth = [], 0
    while True:
        free = F.col("band") - F.length("lead") - F.length("tail")
        large = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("words")).filter((F.col("words") > most) & (free > 1))
        large, m = t.write(large.select(*_KEY), f"large-{depth}", row_count())
        if not m["n"]:
            ready.append(rows)
            break
        ready.append(rows.join(large, _KEY, "left_anti"))
        rows, _ = t.write(halves(rows.join(large, _KEY, "left_semi")), f"halves-{depth}", row_count())
        depth += 1
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[:4]):
            counts = {word: n for *_, word, n in group}
            if len(counts) > 1:
                held += near_in(*key, counts)
            if len(held) > 4096:
                yield rows_of(held, schema)
                held = []
        yield rows_of(held, schema)

    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    parts = every.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(
        compose, "word string, n_near long, form_n long, form string"
    )
    top = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", (-F.col("top.m")).alias("form_n"), "top.form"
    )


def variants(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (word, n), words distinct.

    Forms at least multiply the count by ``ratio``, so following them ends; their chains are
    halved in every round.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2: chains of forms would not end")
    t = RoundTables(words.sparkSession, "spelling")
    try:
        near, _ = t.write(near_words(words, t, most), "near", row_count())
        counted = words.select("word", "n").join(near, "word", "left")
        good = F.col("form_n") >= ratio * F.col("n")
        told, _ = t.write(
            counted.select(
                "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"),
            ),
            "told", row_count(),
        )
        t.delete("near")
        links, m = t.write(told.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "root-0", row_count())
        depth, moved = 0, m["n"]
        while moved:
            on = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
            step = links.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
            depth += 1
            links, m = t.write(step, f"root-{depth}", [F.coalesce(F.sum(F.col("moved").cast("long")), F.lit(0)).alias("n")])
            links, moved = links.select("word", "root"), m["n"]
            t.delete(f"root-{depth - 1}")
        out = told.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
        t.drop_at_exit()
        return out.select("word", "n", "n_near", "form", "form_n", "root")
    except BaseException:
        t.drop()
        raise


def runs(docs: DataFrame, text: str, least: int, *keep: Column) -> DataFrame:
    """(keep..., run): every maximal run of at least ``least`` letters, A-Z lower-cased."""
    lowered = docs.select(*keep, ascii_lower(F.col(text)).alias("_lowered"))
    # a run is found from its first letter or, being too short, not at all
    found = F.regexp_extract_all("_lowered", F.lit(f"[a-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    return lowered.select(*[c for c in lowered.columns if c != "_lowered"], F.explode(found).alias("run"))


def misspelt(found: DataFrame, every: int = 199) -> Column:
    """The run, less one code point where ``every`` divides its check sum with the key."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("_doc").cast("string"), F.lit("")), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    return F.when(h % every == 0, cut).otherwise(F.col("run"))


def op12_spelling(docs: DataFrame) -> DataFrame:
    found = runs(docs, "text", MIN_LETTERS, F.col("doc_id").alias("_doc"))
    words = (
        found.select(misspelt(found).alias("word")).filter(F.length("word") >= MIN_LETTERS)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_COUNT)
    )
    t = RoundTables(docs.sparkSession, "words")
    words, _ = t.write(words, "words", row_count())
    t.drop_at_exit()
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = rf"""
WITH RECURSIVE crc AS (SELECT {CRC32_ENTRIES} AS entries),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents WHERE text IS NOT NULL
), kinds AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL),
sums AS (
  SELECT run, times, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM kinds, crc
), spoilt AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, times FROM sums
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), holes AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    AND length(a.word) = length(b.word)
  UNION SELECT a.word, a.n, w.word, w.n FROM holes a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM holes a JOIN words w ON a.rest = w.word
), near AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS form, max(m) AS form_n FROM pairs GROUP BY word
), told AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN near USING (word)
), chain AS (
  SELECT word, word AS root, 0 AS steps FROM told
  UNION ALL SELECT c.word, t.form, steps + 1 FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL
), roots AS (SELECT word, first(root ORDER BY steps DESC) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM told JOIN roots USING (word)
"""
