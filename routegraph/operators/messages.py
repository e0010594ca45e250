"""Message passing: rounds of send, merge and update over the triplets of a graph.

A round joins every edge with the state of its source, lets the caller's expression make a
message from them, merges the messages that reach a vertex, and updates the vertex's state.
All three are Columns of the caller, so Catalyst sees them whole:

* ``send`` sees the edge's attributes as ``edge.<name>`` and the source's state as
  ``state.<name>``; a null message is not sent;
* ``merge`` is an aggregate of the column ``msg`` (``F.min("msg")``, ``F.sum("msg")`` ...), whose
  partial results collapse what reaches a hub before the shuffle; or, for what is no single
  aggregate, a function from a DataFrame (id, msg) to one with a row per id;
* ``update`` sees the old state under its own names and the merged ``msg`` (null if none).

The edges are a table bucketed by source and are never shuffled in a round; those of a hub lie
in several buckets (see ``edges``). A round shuffles the states that send, the partially merged
messages, and the states for the update. Each round's states are a table under the checkpoint
dir (lineage cut); the number of changed vertices and the caller's ``observe`` metrics come back
on that write. With ``only_changed`` a vertex sends only after a round that changed it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegraph.operators.edges import HUB_EDGES, ROWS_PER_BUCKET, SaltedEdges
from routegraph.operators.graph import Graph
from routegraph.operators.lineage import RoundTables, row_count

Metrics = dict[str, float]


@dataclass(frozen=True)
class Program:
    """What a vertex program does; see the module's text for what each expression sees."""

    #: State columns from the columns of ``vertices``.
    initial: dict[str, Column]
    send: Column
    merge: Column | Callable[[DataFrame], DataFrame]
    #: State columns from old state and ``msg``, or a function of the last round's metrics.
    update: dict[str, Column] | Callable[[Metrics], dict[str, Column]]
    #: Aggregates over the new states (old ones as ``old.<name>``), reported by each round's write.
    observe: dict[str, Column] = field(default_factory=dict)
    only_changed: bool = False


@dataclass(frozen=True)
class Rounds:
    """The states (id and the program's columns) after ``rounds`` rounds, and the last metrics."""

    states: DataFrame
    rounds: int
    metrics: Metrics


def pass_messages(
    vertices: DataFrame, edges: DataFrame, program: Program, max_rounds: int | None = None,
    done: Callable[[Metrics], bool] | None = None, *, database: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET, hub_edges: int = HUB_EDGES,
) -> Rounds:
    """Run ``program`` until no state changes, ``done`` says so, or ``max_rounds`` rounds ran.

    ``vertices``: unique ``id`` and what ``initial`` reads; ``edges``: ``src``, ``dst`` and what
    ``send`` reads. Messages go from ``src`` to ``dst``, and to vertices only.
    """
    names = list(program.initial)
    attributes = [c for c in edges.columns if c not in ("src", "dst")]
    if clash := {"id", "msg", "old", "_changed"} & set(names) | {"state", "edge", "salt", "salts"} & set(attributes):
        raise ValueError(f"names the rounds use themselves: {sorted(clash)}")
    t = RoundTables(vertices.sparkSession, "messages")
    ways = None

    def metrics(old: bool) -> list[Column]:
        changed = F.count_if("_changed") if old else F.count(F.lit(1))
        return [changed.alias("changed"), *[c.alias(n) for n, c in program.observe.items()]]

    try:
        known, m = t.write(edges, "edges", row_count())
        ways = SaltedEdges(t, known, m["n"], "src", "edges_by_src", database, rows_per_bucket, hub_edges)
        t.delete("edges")
        first = vertices.select("id", *[c.alias(n) for n, c in program.initial.items()])
        # a first round has no older state: its metrics see the initial one as old, too
        first = first.select("*", F.struct(*names).alias("old"), F.lit(True).alias("_changed"))
        states, seen = t.write(first, "round=0", metrics(False))
        k = 0
        while seen["changed"] and (max_rounds is None or k < max_rounds) and not (k and done and done(seen)):
            k += 1
            sending = states.filter("_changed") if program.only_changed else states
            front = sending.select(F.col("id").alias("src"), F.struct(*names).alias("state"))
            met = ways.met(front).withColumn("edge", F.struct(*attributes) if attributes else F.lit(None))
            sent = met.select(F.col("dst").alias("id"), program.send.alias("msg")).filter("msg IS NOT NULL")
            merge = program.merge
            merged = sent.groupBy("id").agg(merge.alias("msg")) if isinstance(merge, Column) else merge(sent)
            both = states.select("id", *names).join(merged.select("id", "msg"), "id", "left")
            update = program.update(seen) if callable(program.update) else program.update
            new = both.select("id", F.struct(*names).alias("old"), *[update[n].alias(n) for n in names])
            same = F.lit(True)
            for n in names:
                same = same & F.col(n).eqNullSafe(F.col(f"old.{n}"))
            new = new.select("id", *names, "old", (~same).alias("_changed"))
            after, seen = t.write(new, f"round={k}", metrics(True))
            t.delete(f"round={k - 1}")
            states = after
        t.drop_at_exit()
        return Rounds(states.select("id", *names), k, seen)
    except BaseException:
        t.drop()
        raise
    finally:
        if ways is not None:
            ways.drop()


def hops_by_messages(g: Graph, landmark: int, max_rounds: int | None = None, **options) -> DataFrame:
    """(id, landmark, hops) as ``paths.hops_to`` gives them, as a vertex program over edges walked
    backwards: the plain example of one, and a second way to the same rows."""
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).filter("src != dst").distinct()
    program = Program(
        initial={"hops": F.when(F.col("id") == landmark, F.lit(0)).cast("int")},
        send=F.col("state.hops") + 1,
        merge=F.min("msg"),
        update={"hops": F.coalesce("hops", "msg")},
        only_changed=True,
    )
    states = pass_messages(g.vertex_ids(), back, program, max_rounds, **options).states
    return states.filter("hops IS NOT NULL").select("id", F.lit(landmark).cast("bigint").alias("landmark"), "hops")
