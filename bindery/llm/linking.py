"""Connected groups from blocks of candidates, without all pairs of a block.

`linked` takes blocks (a key and the nodes that share it) and a verifier of
pairs. A first round verifies each node against one hub of each of its blocks
and joins what is similar into components. While blocks hold many pairs between
components, more rounds do so with some more hubs, each against the members of other
components; these hubs are done with their block then and leave it. The last round
verifies all pairs within a block whose nodes are still in different components. A
pair that is left out then lies within one component already, so the components are
the same as if all pairs of all blocks had been verified; rounds with hubs only save
work. Sketches of the nodes, if there are any, keep pairs that can't hold from
leaving the joins of the later rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from bindery.session import free, settled, written

Verify = Callable[[DataFrame], DataFrame]

#: Rounds with hubs at most, hubs of a block in each, and the pairs per member that need no
#: such round: with as many hubs it verifies as many pairs. Sketches are compared within the
#: join, some thousand times as fast as texts, so with them one round, which brings together
#: what is similar, is mostly enough.
TURNS, HUBS, FEW, FEW_SKETCHED = 8, 16, 16, 1000
#: Rounds with hubs end when one has left more than this share of the pairs open.
STALE = 0.8


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of `edges` (a, b) the least node it is connected with.

    Large-star and small-star by turns: each node's neighbours are hung onto the
    least of them, found by an aggregate that is combined before its shuffle, so
    a node with any number of neighbours is never gathered. Ends when a turn
    changes nothing, after about log(nodes) turns.
    """
    now = written(_ordered(edges), "edges")
    mark = _mark(now)
    while True:
        now = written(_small_star(_large_star(now)), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct()
    )


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from the greater to the lesser node."""
    return (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    h = F.xxhash64("a", "b")
    return tuple(
        edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.col("n"), F.min("b")).alias("m"))
    return _ordered(
        both.where(F.col("b") > F.col("a"))
        .join(least, F.col("a") == F.col("n"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    joined = edges.join(least, F.col("a") == F.col("n"))
    hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(hung.union(least.select(F.col("n"), F.col("m"))))


def linked(
    blocks: DataFrame,
    verify: Verify,
    label: str,
    sketches: Callable[[], DataFrame] | None = None,
    near: Column | None = None,
) -> DataFrame:
    """node, root for every node in a verified pair.

    `blocks`: columns key and node, and any others, which go along with the node
    as a_* and b_* of the pairs (a, b) given to `verify`; that returns the pairs
    (a, b) that hold. A node may be in many blocks, a pair in several.

    `sketches`, called after the first round, gives more such columns for each node of
    its pairs, and `near` is a condition on a_* and b_* that all pairs that hold meet.

    Components are contracted as they are found: a round works out how the links
    it has added join the components of the round before, and never goes back to
    earlier links. Blocks whose members have all come together leave the rounds.
    """
    rest = [c for c in blocks.columns if c not in ("key", "node")]
    blocks = written(blocks, f"{label}-blocks")
    hubs = blocks.groupBy("key").agg(
        F.min(F.struct("node", *rest)).alias("hub"), F.count("*").alias("size")
    )
    hubs = hubs.where(F.col("size") > 1)
    sized = written(blocks.join(hubs, "key"), f"{label}-hubs")
    free(blocks)
    a = [F.col("hub.node").alias("a"), *[F.col(f"hub.{c}").alias(f"a_{c}") for c in rest]]
    b = [F.col("node").alias("b"), *[F.col(c).alias(f"b_{c}") for c in rest]]
    first = sized.where(F.col("node") != F.col("hub.node")).select(*a, *b).distinct()
    links = written(verify(first).select("a", "b"), f"{label}-links")
    labels = settled(lambda: components(links), f"{label}-labels")
    # what is still apart, in blocks with more than a hub and one other node
    more = sized.where(F.col("size") > 2).select("key", "node", *rest)
    more = more.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = _mixed(more)
    few = FEW
    if sketches:
        more, few = more.join(sketches(), "node"), FEW_SKETCHED
        rest = [c for c in more.columns if c not in ("key", "node", "root", "size")]
    near = F.lit(True) if near is None else near
    apart = written(more, f"{label}-apart")
    free(sized)
    before = None
    for turn in range(1, TURNS + 1):
        pairs, nodes = _open_pairs(apart)
        if not pairs:
            return labels
        enough = pairs <= (few if before else FEW) * nodes
        if enough or turn == TURNS or before and pairs > STALE * before:
            break
        before = pairs
        # some more hubs for each block, against the members of other components
        drawn = apart.withColumn("hub", _drawn(turn))
        left = _side(drawn.where("hub"), "a", rest)
        right = _side(drawn, "b", [*rest, "hub"])
        once = ~F.col("b_hub") | (F.col("a") < F.col("b"))
        next_ = left.join(right, "key").where((F.col("a_root") != F.col("b_root")) & once & near)
        next_ = next_.select(*_pair(rest)).distinct()
        labels, merged = _merged(labels, written(verify(next_).select("a", "b"), f"{label}-links"))
        left_over = drawn.where(~F.col("hub")).drop("hub")
        if merged is not None:
            left_over = _relabelled(left_over, merged)
        last, apart = apart, written(_mixed(left_over), f"{label}-apart")
        free(last)
    crossing = _side(apart, "a", rest).join(_side(apart, "b", rest), "key")
    crossing = crossing.where((F.col("a_root") < F.col("b_root")) & near).select(*_pair(rest))
    second = verify(crossing.distinct()).select("a", "b")
    return _merged(labels, written(second, f"{label}-links"))[0]


def _drawn(turn: int) -> Column:
    """Whether a member is a hub of its block: about HUBS are, all of a block of so many."""
    return F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 32)) * F.col("size") < HUBS << 32


def _side(members: DataFrame, end: str, columns: list[str]) -> DataFrame:
    """key, `end` for the node, and its root and `columns` with `end` before their names."""
    more = [F.col(c).alias(f"{end}_{c}") for c in ("root", *columns)]
    return members.select("key", F.col("node").alias(end), *more)


def _pair(rest: list[str]) -> list[str]:
    return ["a", *[f"a_{c}" for c in rest], "b", *[f"b_{c}" for c in rest]]


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """`rows` with the `root` that each root has come to; `merged` has node and root."""
    new = merged.select(F.col("node").alias("root"), F.col("root").alias("_new"))
    rows = rows.join(new, "root", "left")
    return rows.withColumn("root", F.coalesce("_new", "root")).drop("_new")


def _merged(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Labels after more links, and how roots have changed; None if there are no links.

    Only the ends of the new links are looked up, and only their roots joined.
    """
    if links.isEmpty():
        return labels, None
    for end in ("a", "b"):
        of = labels.select(F.col("node").alias(end), F.col("root").alias("_root"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    merged = settled(lambda: components(links.select("a", "b")), "merged")
    fresh = merged.join(labels, "node", "left_anti")  # nodes that were alone so far
    moved = _relabelled(labels, merged).select("node", "root")
    return written(moved.union(fresh.select("node", "root")), "labels"), merged


def _mixed(rooted: DataFrame) -> DataFrame:
    """Members of blocks that hold several components, with the `size` of the block."""
    mixed = rooted.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")
    )
    mixed = mixed.where(F.col("lo") != F.col("hi")).select("key", "size")
    return rooted.drop("size").join(mixed, "key")


def _open_pairs(apart: DataFrame) -> tuple[int, int]:
    """How many pairs within blocks are between components, and how many members there are."""
    sizes = apart.groupBy("key", "root").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("key").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within")
    )
    open_ = F.sum((F.col("n") * F.col("n") - F.col("within")) / 2)
    row = whole.agg(F.coalesce(open_, F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return int(row[0]), int(row[1])
