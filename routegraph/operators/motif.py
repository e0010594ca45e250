"""Structural pattern ("motif") search over a Graph, built from joins.

A pattern is a list of terms: ``Edge("a", "b")`` matches one edge a->b and
``Not(Edge("c", "a"))`` requires that no edge c->a exists. Terms that share a vertex
name are joined on that name; every positive term is one equi-join with the edge
table, every negated term one ``left_anti`` join.

Semantics
* Vertex names bind to vertex ids; an edge whose endpoint is not a vertex never matches.
* Without negation, ``find`` returns one row per combination of edges, so parallel
  edges repeat a match (multigraph semantics). With negation it returns the distinct
  vertex bindings.
* Patterns must be connected: a term that shares no name with the terms before it
  would need a cross join, which we refuse.

Plan shape
* Terms are joined seeded-term first, then each term that touches an already-bound
  name, so a seed filter (``seeds={"a": [5]}``) is pushed into the first edge scan and
  every later join is driven by a small input that AQE can broadcast at runtime.
* ``count_matches`` is the aggregated form: it carries a multiplicity column and sums
  away each vertex name as soon as no later term needs it (and, without seeds, reduces
  each term to counts per join key before joining), so counting 2-edge walks -- from a
  hub or over the whole graph -- never materialises the walks themselves.
* Vertex-existence checks are inner joins with the (unique) vertex ids, so the smaller
  side can be broadcast whichever it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routegraph.operators.edges import fits
from routegraph.operators.graph import Graph
from routegraph.operators.lineage import RoundTables, row_count


@dataclass(frozen=True)
class Edge:
    src: str
    dst: str
    name: str | None = None  # keep the edge's attributes as a struct column of this name


@dataclass(frozen=True)
class Not:
    edge: Edge


Seeds = dict  # name -> list of ids | DataFrame with an ``id`` column


def _split(pattern) -> tuple[list[Edge], list[Edge]]:
    pos, neg = [], []
    for t in pattern:
        if isinstance(t, Edge):
            pos.append(t)
        elif isinstance(t, Not) and isinstance(t.edge, Edge):
            neg.append(t.edge)
        else:
            raise TypeError(f"pattern terms are Edge or Not(Edge); got {t!r}")
    if not pos:
        raise ValueError("a pattern needs at least one positive Edge term")
    bound = {n for e in pos for n in (e.src, e.dst)}
    for e in neg:
        if e.src not in bound or e.dst not in bound:
            raise ValueError(f"negated term {e} uses a name not bound by a positive term")
        if e.name:
            raise ValueError("a negated edge cannot be named")
    names = [e.name for e in pos if e.name]
    if len(names) != len(set(names)) or bound & set(names):
        raise ValueError("edge names must be unique and differ from vertex names")
    return pos, neg


def _order(pos: list[Edge], seeds: Seeds) -> list[Edge]:
    """Seeded term first, then terms connected to what is already bound."""
    names = {n for e in pos for n in (e.src, e.dst)}
    unknown = sorted(set(seeds) - names)
    if unknown:
        raise ValueError(f"seeds for names not in the pattern: {unknown}")
    rest = list(pos)
    start = next((e for e in rest if e.src in seeds or e.dst in seeds), rest[0])
    rest.remove(start)
    order, bound = [start], {start.src, start.dst}
    while rest:
        nxt = next((e for e in rest if e.src in bound or e.dst in bound), None)
        if nxt is None:
            raise ValueError("pattern is not connected; that would need a cross join")
        rest.remove(nxt)
        order.append(nxt)
        bound |= {nxt.src, nxt.dst}
    return order


def _restrict(df: DataFrame, col: str, seed) -> DataFrame:
    if isinstance(seed, DataFrame):
        return df.join(seed.select(F.col("id").alias(col)).distinct(), col, "left_semi")
    ids = list(seed)
    return df.filter(F.col(col).isin(ids))


def _edge_term(g: Graph, e: Edge, seeds: Seeds) -> DataFrame:
    cols = [F.col("src").alias(e.src)]
    if e.dst != e.src:
        cols.append(F.col("dst").alias(e.dst))
    if e.name:
        cols.append(F.struct(*[F.col(c) for c in g.edges.columns]).alias(e.name))
    edges = g.edges
    if e.src == e.dst:
        edges = edges.filter(F.col("src") == F.col("dst"))
    df = edges.select(*cols)
    for n in {e.src, e.dst}:
        if n in seeds:
            df = _restrict(df, n, seeds[n])
    return df


def _exists(df: DataFrame, g: Graph, name: str) -> DataFrame:
    return df.join(g.id_lookup().withColumnRenamed("id", name), name)


def _join_positive(g: Graph, order: list[Edge], seeds: Seeds, mult: bool, keep: list[str]):
    """Join the positive terms; with ``mult`` carry and pre-aggregate a multiplicity column.

    In ``mult`` mode without seeds (whole-graph counting), each later term is first reduced
    to counts per join key -- its new vertex names that nothing later needs are checked for
    existence and summed away *before* the join -- so the join sees one row per key pair
    instead of one per walk. With a seed the running side is already small, so terms are
    joined as they are and aggregated right after.
    """
    cur: DataFrame | None = None
    bound: list[str] = []
    grouped = False  # is ``cur`` already one row per ``bound`` combination?
    tables: RoundTables | None = None
    for i, e in enumerate(order):
        grouped = False
        names = list(dict.fromkeys([e.src, e.dst]))
        term = _edge_term(g, e, seeds)
        shared = [n for n in names if n in bound]
        later = {n for t in order[i + 1 :] for n in (t.src, t.dst)} | set(keep)
        if cur is None:
            cur = term.groupBy(*names).agg(F.count(F.lit(1)).alias("_m")) if mult else term
        elif mult and not seeds:
            new = [n for n in names if n not in bound]
            # one row per pair of vertices, whatever the number of parallel edges, before
            # the vertex checks
            t = term.groupBy(*names).agg(F.count(F.lit(1)).alias("_t"))
            for n in new:
                t = _exists(t, g, n)
            live_t = [n for n in names if n in bound or n in later]
            if len(live_t) < len(names):
                t = t.groupBy(*live_t).agg(F.sum("_t").alias("_t"))
            tables = tables or RoundTables(g.vertices.sparkSession, "walks")
            cur = _hub_join(cur, t, shared, tables, str(i)).withColumn("_m", F.col("_m") * F.col("_t")).drop("_t")
            bound += [n for n in new if n in live_t]
            names = []  # existence already checked on the term side
        else:
            cur = cur.join(term, shared)
        for n in names:
            if n not in bound:
                cur = _exists(cur, g, n)
                bound.append(n)
        if mult:
            live = [n for n in bound if n in later]
            if len(live) < len(bound) or i == 0:
                cur = cur.groupBy(*live).agg(F.sum("_m").alias("_m"))
                bound, grouped = live, True
    if tables is not None:
        tables.drop_at_exit()
    return cur, bound, grouped


def _hub_join(cur: DataFrame, t: DataFrame, shared: list[str], tables: RoundTables, rel: str) -> DataFrame:
    """``cur`` joined with the per-key counts ``t``, a hub's rows not in one task.

    The counts are written and so counted: if they fit the broadcast budget, ``cur`` is not
    shuffled at all. Otherwise ``cur`` is written, too: AQE splits a skewed key where both
    sides are plain scans, which an aggregate under the join is not.
    """
    t, m = tables.write(t, f"{rel}-counts", row_count())
    if fits(tables.spark, m["n"]):
        return cur.join(F.broadcast(t), shared)
    cur, _ = tables.write(cur, f"{rel}-walks", row_count())
    return cur.join(t, shared)


def find(g: Graph, pattern, seeds: Seeds | None = None) -> DataFrame:
    """All matches of ``pattern`` as rows of vertex-id columns (plus named edge structs)."""
    seeds = dict(seeds or {})
    pos, neg = _split(pattern)
    order = _order(pos, seeds)
    vertex_names = list(dict.fromkeys(n for e in pos for n in (e.src, e.dst)))
    if not neg:
        cur, _, _ = _join_positive(g, order, seeds, mult=False, keep=[])
        return cur.select(*vertex_names, *[e.name for e in pos if e.name])
    return _find_distinct(g, order, neg, seeds).select(*vertex_names)


def _find_distinct(g: Graph, order: list[Edge], neg: list[Edge], seeds: Seeds) -> DataFrame:
    """Distinct vertex bindings of a pattern with negations.

    * Each negation is applied as soon as both of its names are bound, so it filters the
      smallest possible intermediate (``!(b)->(a)`` prunes a->b pairs before the next join).
    * Each positive term is reduced to distinct (src, dst) pairs before its join: a binding
      then arises from exactly one pair per term, parallel edges never multiply, and the
      join output is distinct without an aggregation over it. With seeds, a later term
      first keeps only the edges at vertices that the terms before it bound, so the whole
      edge set is neither shuffled for the distinct nor for the join.
    """
    pending = list(neg)
    cur: DataFrame | None = None
    bound: list[str] = []
    for e in order:
        names = list(dict.fromkeys([e.src, e.dst]))
        term = _edge_term(g, Edge(e.src, e.dst), seeds)
        shared = [n for n in names if n in bound]
        if seeds and cur is not None:
            term = term.join(cur.select(*shared).distinct(), shared, "left_semi")
        term = term.distinct()
        cur = term if cur is None else cur.join(term, shared)
        for n in names:
            if n not in bound:
                cur = _exists(cur, g, n)
                bound.append(n)
        for x in [x for x in pending if x.src in bound and x.dst in bound]:
            pending.remove(x)
            cur = cur.join(_negated_edges(g, x, seeds), list(dict.fromkeys([x.src, x.dst])), "left_anti")
    return cur


def _negated_edges(g: Graph, e: Edge, seeds: Seeds) -> DataFrame:
    if e.src == e.dst:
        other = g.edges.filter(F.col("src") == F.col("dst")).select(F.col("src").alias(e.src))
    else:
        other = g.edges.select(F.col("src").alias(e.src), F.col("dst").alias(e.dst))
    # A seeded endpoint shrinks the anti-join's right side to the seed's edges.
    for n in dict.fromkeys([e.src, e.dst]):
        if n in seeds:
            other = _restrict(other, n, seeds[n])
    return other


def count_matches(g: Graph, pattern, keep, seeds: Seeds | None = None) -> DataFrame:
    """(keep..., n_matches): number of edge combinations matching a positive pattern,
    grouped by the vertex names in ``keep`` (empty ``keep`` gives one total row)."""
    seeds = dict(seeds or {})
    keep = list(keep)
    pos, neg = _split(pattern)
    if neg:
        raise ValueError("count_matches takes positive patterns; use find() with negation")
    for n in keep:
        if not any(n in (e.src, e.dst) for e in pos):
            raise ValueError(f"keep name {n!r} is not in the pattern")
    order = _order(pos, seeds)
    cur, bound, grouped = _join_positive(g, order, seeds, mult=True, keep=keep)
    if grouped and set(bound) == set(keep):
        return cur.select(*keep, F.col("_m").alias("n_matches"))
    return cur.groupBy(*keep).agg(F.sum("_m").alias("n_matches"))


def attach(df: DataFrame, g: Graph, name: str, columns: list[str] | None = None) -> DataFrame:
    """Replace the id column ``name`` by a struct of that vertex's attributes (``name.id`` etc.)."""
    cols = columns or g.vertices.columns
    if "id" not in cols:
        cols = ["id", *cols]
    v = g.vertex_table(*cols).select(F.col("id").alias(f"__{name}"), F.struct(*cols).alias(f"__{name}_s"))
    out = df.join(v, df[name] == v[f"__{name}"])
    return out.select(*[F.col(f"__{name}_s").alias(name) if c == name else F.col(c) for c in df.columns])
