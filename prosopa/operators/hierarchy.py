"""Parent-child rows of unknown depth as nested sets: path, depth, root, descendants, cycles.

Sizes go up and preorder offsets come down in doubling steps: after step k a node's pointer names the
ancestor 2^k levels above, and it knows the sum over the descendants less than 2^k levels below (or over
its 2^k nearest ancestors), so a tree of height h takes about log2(h) joins rather than h. Only rows whose
pointer still names a node take part in a step, and only nodes that are named are looked up. Roots and
depths are read off the finished ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosopa.session import cut, cut_told, release, slice_join

#: More rows than this that point to one node are split over several tasks.
ROWS_PER_SLICE = 250_000
#: Positions of the preorder that one window covers.
BLOCK_BITS = 16


def father_links(kin: DataFrame, codes: DataFrame) -> DataFrame:
    """(node, parent) of the kin rows coded F (c_kin_id is the father) or S (c_kin_id is a son), repeats
    included. Rows with a null or 0 id, with equal ids, or with an unknown or null code are no links."""
    kind = codes.select(F.col("c_kincode").alias("c_kin_code"), F.col("c_kinrel_simplified").alias("rel")).where(
        F.col("rel").isin("F", "S")
    ).distinct()
    row = kin.select("c_personid", "c_kin_id", "c_kin_code").where(
        (F.col("c_personid") != 0) & (F.col("c_kin_id") != 0) & (F.col("c_personid") != F.col("c_kin_id"))
    )
    father = F.col("rel") == "F"
    return row.join(kind, "c_kin_code").select(
        F.when(father, F.col("c_personid")).otherwise(F.col("c_kin_id")).alias("node"),
        F.when(father, F.col("c_kin_id")).otherwise(F.col("c_personid")).alias("parent"),
    )


def _links(links: DataFrame) -> DataFrame:
    """(node, parent) as whole numbers, without null ids and self links."""
    row = links.select(F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"))
    return row.where(F.col("node").isNotNull() & F.col("parent").isNotNull() & (F.col("node") != F.col("parent")))


def rejected_links(links: DataFrame) -> DataFrame:
    """(node, parent, kept_parent): the links that `nested_sets` leaves out because the node has a
    smaller parent as well, each once."""
    row = _links(links).groupBy("node").agg(F.collect_set("parent").alias("all"), F.min("parent").alias("kept_parent"))
    row = row.select("node", F.explode("all").alias("parent"), "kept_parent")
    return row.where(F.col("parent") != F.col("kept_parent"))


def _ask(askers: DataFrame, told: DataFrame, hot: bool) -> DataFrame:
    """`askers` (node, up, ...) joined to the row of `told` whose `up` their pointer names; a node that
    very many rows name is sliced."""
    return slice_join(askers, told, ["up"], ["node"], ROWS_PER_SLICE) if hot else askers.join(told, "up")


def nested_sets(links: DataFrame) -> DataFrame:
    """One row for each node of `links` (node, parent): node, parent, root, depth, size, pre, root_size.

    pre .. pre + size - 1 is the node's range in one preorder of all trees, siblings in id order (those of
    a parent with more than ROWS_PER_SLICE children, and the roots, in a pseudorandom order); a node is an
    ancestor of another exactly if its range holds the other's pre. root and depth follow from the ranges that
    are open at pre. Nodes on or below a cycle are never finished: they have depth -1, the smallest id on that
    cycle as root, and null size, pre and root_size. Null ids, self links and repeated links are dropped; of
    several parents the smallest is kept (the others are `rejected_links`). No links: no rows.
    """
    one = _links(links).groupBy("node").agg(F.min("parent").alias("parent"))
    kids = one.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    base, told = cut_told(one.join(kids, "node", "full"), linked=F.count("parent"), roots=F.count_if(F.col("parent").isNull()), widest=F.max("kids"))
    left, widest, roots = told["linked"], told["widest"] or 0, told["roots"]

    # Upward: `up` is the ancestor 2^k levels above, `size` the descendants less than 2^k levels below,
    # itself included. The first step is known from the children.
    moving = base.where(F.col("parent").isNotNull()).select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"))
    below = base.where(F.col("kids").isNotNull()).select("node", F.col("kids").alias("more"))
    named, hots, steps = [below], [widest > ROWS_PER_SLICE], []
    while left:
        far = moving.select(F.col("node").alias("up"), F.col("up").alias("next"))
        step = _ask(moving, far, hots[-1]).select("node", F.col("next").alias("up"), "size")
        step = step.join(below, "node", "left").select("node", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        moving, told = cut_told(step, rows=F.count(F.lit(1)))
        steps.append(moving)
        if told["rows"] in (0, left):
            left = told["rows"]
            break
        left = told["rows"]
        named.append(moving.select(F.col("up").alias("node"), F.col("size").alias("more")))
        below = named[-1].groupBy("node").agg(F.sum("more").alias("more"))
        hots.append(left > ROWS_PER_SLICE and moving.groupBy("up").count().agg(F.max("count")).first()[0] > ROWS_PER_SLICE)
    looped = cut(_cycles(base, moving.select("node", "up"))) if left else None

    # A node's size is the sum of what it was told; `reach` the last step in which it was named.
    sums = named[0].select("node", "more", F.lit(0).alias("k"))
    for k, part in enumerate(named[1:], 1):
        sums = sums.unionByName(part.select("node", "more", F.lit(k).alias("k")))
    sums = sums.groupBy("node").agg((F.sum("more") + 1).alias("size"), F.max("k").alias("reach"))
    tree = base if looped is None else base.join(looped.select("node"), "node", "left_anti")
    sized = cut(tree.join(sums, "node", "left").select("node", "parent", F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("reach", F.lit(-1)).alias("reach")))

    # Downward: an offset is 1 + the sizes of the earlier siblings, of a root the sizes of the earlier trees;
    # the offsets on the way from a node up to its root add up to its preorder number.
    state = _offsets(sized, base, widest, roots).withColumn("fresh", F.col("up").isNull())
    done, states = [], []
    for k, hot in enumerate(hots):
        state = cut(state)
        states.append(state)
        done.append(state.where("fresh").select("node", "pre"))
        far = state.where(F.col("reach") >= k).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("pre").alias("add"))
        step = _ask(state.where(F.col("up").isNotNull()), far, hot)
        step = step.select("node", F.col("next").alias("up"), (F.col("pre") + F.col("add")).alias("pre"), "reach", F.col("next").isNull().alias("fresh"))
        state = step.unionByName(state.where(F.col("up").isNull() & (F.col("reach") > k)).select("node", "up", "pre", "reach", F.lit(False).alias("fresh")))
    placed = state.where("fresh").select("node", "pre")
    for part in done:
        placed = placed.unionByName(part)
    ranged = cut(placed.join(sized.drop("reach"), "node"))
    release(sized, *steps, *states)
    trees = _opened(ranged)
    if looped is None:
        return trees
    none = F.lit(None).cast("long")
    return trees.unionByName(
        base.join(looped, "node").select("node", "parent", "root", F.lit(-1).alias("depth"), none.alias("size"), none.alias("pre"), none.alias("root_size"))
    )


def _offsets(sized: DataFrame, base: DataFrame, widest: int, roots: int) -> DataFrame:
    """(node, up, pre, reach): each node's offset below its parent as `pre`. The children of a parent are
    summed in one window; those of a parent with too many, and the roots, in hash buckets of
    bounded size and then over the buckets."""
    row = sized.select("node", F.col("parent").alias("up"), "size", "reach")
    root = row.where(F.col("up").isNull()).withColumn("_buckets", F.lit(roots // ROWS_PER_SLICE + 1))
    child, wide = row.where(F.col("up").isNotNull()), root
    if widest > ROWS_PER_SLICE:
        hot = base.where(F.col("kids") > ROWS_PER_SLICE).select(F.col("node").alias("up"), (F.col("kids") / ROWS_PER_SLICE + 1).cast("int").alias("_buckets"))
        marked = child.join(hot, "up", "left")
        wide = root.unionByName(marked.where(F.col("_buckets").isNotNull()))
        child = marked.where(F.col("_buckets").isNull()).drop("_buckets")
    before = lambda *keys, order="node": Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.when(F.col("up").isNull(), 0).otherwise(1)
    narrow = child.withColumn("pre", F.coalesce(F.sum("size").over(before("up")), F.lit(0)) + 1)
    wide = wide.withColumn("_bucket", F.pmod(F.xxhash64("node"), F.col("_buckets").cast("long")))
    held = wide.groupBy("up", "_bucket").agg(F.sum("size").alias("_held"))
    start = held.select(F.col("up").alias("_up"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_held").over(before("up", order="_bucket")), F.lit(0)).alias("_start"))
    ahead = wide.withColumn("_ahead", F.coalesce(F.sum("size").over(before("up", "_bucket")), F.lit(0)))
    wide = ahead.join(start, F.col("up").eqNullSafe(F.col("_up")) & (F.col("_bucket") == F.col("_b"))).withColumn("pre", F.col("_start") + F.col("_ahead") + first)
    return narrow.select("node", "up", "pre", "reach").unionByName(wide.select("node", "up", "pre", "reach"))


def _opened(ranged: DataFrame) -> DataFrame:
    """The rows with root, root_size and depth: the ranges open at a node's preorder number are its own and
    those of its ancestors, the outermost of them its root's. Starts and ends are summed up in order inside
    blocks of preorder numbers; a second pass over one row for each block carries the sums on."""
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    root = F.when(F.col("parent").isNull(), F.struct("pre", "node", "size"))
    start = ranged.select("node", "parent", "size", "pre", F.col("pre").alias("at"), F.lit(1).alias("step"), root.alias("tree"))
    end = ranged.select(
        F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("pre"),
        (F.col("pre") + F.col("size")).alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("struct<pre:bigint,node:bigint,size:bigint>").alias("tree"),
    )
    event = start.unionByName(end).withColumn("block", block("at"))
    total = event.groupBy("block").agg(F.sum("step").alias("net"), F.max("tree").alias("last"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select("block", F.coalesce(F.sum("net").over(earlier), F.lit(0)).alias("carry"), F.max("last").over(earlier).alias("carried"))
    inside = Window.partitionBy("block").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = event.withColumn("open", F.sum("step").over(inside)).withColumn("outer", F.last("tree", ignorenulls=True).over(inside))
    row = swept.where(F.col("step") == 1).join(carried, "block").withColumn("tree", F.coalesce("outer", "carried"))
    return row.select("node", "parent", F.col("tree.node").alias("root"), (F.col("open") + F.col("carry") - 1).cast("int").alias("depth"), "size", "pre", F.col("tree.size").alias("root_size"))


def _cycles(base: DataFrame, going: DataFrame) -> DataFrame:
    """(node, root) for the nodes whose pointers never end: root is the smallest id on their cycle.

    Pointers are doubled until the set they name stops shrinking; it then is the set of cycle nodes.
    A minimum doubled around each cycle until it no longer changes is the cycle's smallest id.
    """
    named = going.select("up").distinct().count()
    while True:
        going = cut(going.join(going.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")))
        now = going.select("up").distinct().count()
        if now == named:
            break
        named = now
    ring = base.join(going.select(F.col("up").alias("node")).distinct(), "node").select("node", F.col("parent").alias("to"), F.least("node", "parent").alias("low"))
    changed = True
    while changed:
        far = ring.select(F.col("node").alias("to"), F.col("to").alias("far_to"), F.col("low").alias("far_low"))
        grown = ring.join(far, "to").select("node", F.col("far_to").alias("to"), F.least("low", "far_low").alias("low"), (F.col("far_low") < F.col("low")).alias("_changed"))
        grown, told = cut_told(grown, changed=F.count_if(F.col("_changed")))
        ring, changed = grown.drop("_changed"), told["changed"]
    return going.join(ring.select(F.col("node").alias("up"), F.col("low").alias("root")), "up").select("node", "root")


def ancestor_pairs(sets: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
    """(ancestor, ancestor_depth, node, node_depth) for every node and each of its ancestors, itself
    included, read off the nested-set ranges; with `ancestors` (column node) only those of them.

    A range is cut into its aligned power-of-two blocks (at most two of each width), a preorder
    number lies in one aligned block of each width up to its tree's size; equal (width, block)
    is containment, so the range join is an equi-join. Nodes on or below cycles are left out.
    """
    tree = sets.where(F.col("depth") >= 0)
    lo, hi = F.col("pre"), F.col("pre") + F.col("size")
    none = F.array().cast("array<bigint>")

    def pieces(k):
        """The canonical blocks of width 2^k of the range, by number: at most one at either end."""
        unit = F.pow(F.lit(2.0), k)
        first, last = F.ceil(lo / unit).cast("long"), F.floor(hi / unit).cast("long")
        left = F.when((first < last) & (first % 2 == 1), F.array(first)).otherwise(none)
        right = F.when((first < last) & (last % 2 == 1), F.array(last - 1)).otherwise(none)
        return F.transform(F.concat(left, right), lambda b: F.struct(k.alias("k"), b.alias("b")))

    # A block that is no part of a wider one inside the range starts or ends at one, so widths end at the size.
    width = lambda c: F.length(F.bin(c)) - 1
    levels = F.sequence(F.lit(0), width("size"))
    chosen = tree if ancestors is None else tree.join(ancestors.select("node").distinct(), "node", "left_semi")
    spans = chosen.select(
        F.col("node").alias("ancestor"), F.col("depth").alias("ancestor_depth"), F.explode(F.flatten(F.transform(levels, pieces))).alias("at")
    ).select("ancestor", "ancestor_depth", "at.k", "at.b")
    points = (
        tree.select("node", F.col("depth").alias("node_depth"), "pre", F.explode(F.sequence(F.lit(0), width("root_size"))).alias("k"))
        .withColumn("b", F.floor(F.col("pre") / F.pow(F.lit(2.0), F.col("k"))).cast("long"))
        .drop("pre")
    )
    pairs = slice_join(points, spans, ["k", "b"], ["node"], 65536)
    return pairs.select("ancestor", "ancestor_depth", "node", "node_depth")


def paths(sets: DataFrame, separator: str = "/") -> DataFrame:
    """(node, path): the ids from the root down to the node, for nodes off cycles; null for others."""
    steps = ancestor_pairs(sets).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("ancestor_depth", "ancestor"))).alias("up"))
    joined = F.array_join(F.transform("up", lambda s: s["ancestor"].cast("string")), separator)
    return sets.select("node").join(steps.select("node", joined.alias("path")), "node", "left")


def descendants_of(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for the descendants of the ids in `chosen` (column node)."""
    pair = ancestor_pairs(sets, chosen)
    return pair.where(F.col("ancestor") != F.col("node")).select("ancestor", "node", (F.col("node_depth") - F.col("ancestor_depth")).alias("distance"))


__all__ = ["ancestor_pairs", "descendants_of", "father_links", "nested_sets", "paths", "rejected_links"]
