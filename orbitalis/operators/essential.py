"""Essential trees: what a part of space needs to know of all others.

Each part (a range of keys) has a bounding box.  Top down, a cell that is far
enough from the whole box is sent as one record; a leaf that isn't is sent too
(with its bodies, if asked for); any other cell gives way to its children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.functions import geometry as g
from orbitalis.operators import cells as tree
from orbitalis.operators import direct, walk
from orbitalis.operators.scratch import cut


def part_boxes(bodies: DataFrame, *within: str) -> DataFrame:
    """part and the box of its bodies, or one for each value of other columns."""
    return bodies.groupBy("part", *within).agg(*(f(c).alias(n + c) for f, n in ((F.min, "l"), (F.max, "h")) for c in "xyz"))


_VALID = "coalesce(mass > 0 and mass < double('inf') and not isnan(cx + cy + cz) and abs(cx) + abs(cy) + abs(cz) < double('inf'), false)"


def interactions(cells: DataFrame, boxes: DataFrame, theta: float, span: float, digit: int = 3, max_depth: int = 21, domain=None, by: str | None = None) -> DataFrame:
    """dest, depth, prefix, n, mass, cx, cy, cz, is_leaf and state of the cells at which
    the descent for each destination ends: together they hold all bodies.

    boxes: part and a box; a destination may have many boxes, all of which must
    accept a cell.  A cell is accepted by a box if its side is less than theta times
    the distance of the box from its centre of mass, or, if the domain is given,
    from the cell itself.  States: far (accepted), near (a leaf that isn't), cut (neither, but
    at max_depth) and skipped (without mass or centre: neither it nor what is below it acts).
    by: a column of cells that tells trees apart, of which none is sent to the
    destination of its own number.
    """
    own = [by] if by else []
    known = cut(cells.select(*own, "depth", "prefix", "n", "mass", "cx", "cy", "cz", "is_leaf", F.expr(_VALID).alias("_valid")))
    shapes = cut(boxes.groupBy(F.col("part").alias("dest")).agg(F.collect_list(F.struct(*(a + c for a in "lh" for c in "xyz"))).alias("boxes")))
    side = g.cell_side(F.col("depth"), span)
    if domain is None:
        low = high = g.cols("c")
    else:
        middle = g.cell_centre(F.col("depth"), F.col("prefix"), domain)
        low, high = (tuple(m + s * side / 2 for m in middle) for s in (-1, 1))

    def fails(b):
        return side * side >= theta**2 * g.box_gap2(low, high, [b["l" + c] for c in "xyz"], [b["h" + c] for c in "xyz"])

    up = F.shiftright("prefix", digit).alias("_up")
    state = F.when(~F.col("_valid"), "skipped").when(~F.exists("boxes", fails), "far").when(F.col("is_leaf"), "near").when(F.col("depth") == max_depth, "cut").otherwise("opened")
    frontier = shapes.select("dest").withColumn("_up", F.lit(0).cast("long"))
    out = None
    for level in range(max_depth + 1):
        here = known.where(F.col("depth") == level).select("*", up)
        met = frontier.join(here, [*(own if level else []), "_up"])  # the children that there are
        if by and not level:
            met = met.where(F.col(by) != F.col("dest"))
        met = cut(met.join(shapes, "dest").withColumn("state", state).drop("boxes", "_valid", "_up"))
        ends, opened = met.where("state <> 'opened'"), met.where("state = 'opened'")
        out = ends if out is None else out.unionByName(ends)
        if level == max_depth or opened.isEmpty():
            break
        frontier = opened.select("dest", *own, F.col("prefix").alias("_up"))
    return out


def records(cells: DataFrame, boxes: DataFrame, theta: float, span: float, digit: int = 3, max_depth: int = 21, domain=None, by: str | None = None) -> DataFrame:
    """What each destination receives of interactions(): all but what is skipped, with
    accepted.  A record that is no leaf acts as one mass, accepted or cut off."""
    found = interactions(cells, boxes, theta, span, digit, max_depth, domain, by)
    return found.where("state <> 'skipped'").withColumn("accepted", F.col("state") == "far").drop("state")


def account(found: DataFrame) -> DataFrame:
    """The bodies and mass of interactions() by destination and state."""
    return found.groupBy("dest", "state").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))


def with_bodies(sent: DataFrame, placed: DataFrame, by: str | None = None) -> DataFrame:
    """The bodies of the leaves that were sent because they're near."""
    own = [by] if by else []
    near = sent.where("not accepted and is_leaf").select("dest", *own, F.col("depth").alias("leaf_depth"), F.col("prefix").alias("leaf_prefix"))
    return near.join(placed, [*own, "leaf_depth", "leaf_prefix"])


def coarse(cells: DataFrame, bodies: DataFrame, depth: int, digit: int = 3) -> DataFrame:
    """The top of the tree with the parts that own bodies of each cell."""
    from orbitalis.functions import keys

    owned = bodies.select("part", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"), "key")
    owned = owned.withColumn("prefix", keys.prefix_at(F.col("key"), F.col("depth"), digit)).groupBy("depth", "prefix").agg(F.count_distinct("part").alias("owners"))
    return cells.where(F.col("depth") <= depth).join(owned, ["depth", "prefix"])


def residual(cells: DataFrame, placed: DataFrame) -> DataFrame:
    """Mass of leaves beyond that of their own bodies, with its centre (by subtraction)."""
    m = F.col("mass")
    own = placed.groupBy(F.col("leaf_depth").alias("depth"), F.col("leaf_prefix").alias("prefix")).agg(F.sum(m).alias("_m"), *(F.sum(m * F.col(c)).alias("_" + c) for c in "xyz"))
    both = cells.where("is_leaf").join(own, ["depth", "prefix"], "left").fillna({"_m": 0.0, "_x": 0.0, "_y": 0.0, "_z": 0.0})
    rest = m - F.col("_m")
    return both.where(rest > 0).select("depth", "prefix", rest.alias("mass"), *(((m * F.col("c" + c) - F.col("_" + c)) / rest).alias("c" + c) for c in "xyz"))


def merged(own: DataFrame, received: DataFrame) -> DataFrame:
    """A part's own cells and what it received, as one tree."""
    return tree.merge_records(own.select(*received.columns), received)


def accelerations(placed: DataFrame, config, domain, theta: float | None = None) -> DataFrame:
    """id, ax, ay, az, phi of bodies (with key and part) where each part knows its own
    bodies and what the others send it: records of far cells, which act as one mass
    on all its bodies without a further test, and the bodies of near leaves.

    Each part's bodies have a tree of their own; all trees are built, sent and walked
    together, so the number of jobs doesn't grow with the parts.
    """
    placed = cut(placed)
    middle = tuple(lo + domain.span / 2 for lo in domain.low)
    cells = cut(tree.tree(placed, config.leaf_size, config.depth, config.digit, origin=middle, by=("part",)))
    sent = cut(records(cells, part_boxes(placed), config.theta if theta is None else theta, domain.span, config.digit, config.depth, by="part"))
    far = sent.where("accepted or not is_leaf").select("dest", "mass", "cx", "cy", "cz")
    near = with_bodies(sent, tree.with_leaf(placed, cells, config.depth, config.digit, "part"), "part")
    received = far.unionByName(near.select("dest", "mass", *(F.col(c).alias("c" + c) for c in "xyz")))
    acted = direct.by_records(placed, received, config.softening, config.gravity, 0.0, "part")
    if config.theta == 0:  # nothing is accepted: a walk would meet each body with each cell
        own = direct.within_parts(placed, config.softening, config.gravity, "part")
    else:
        own = walk.Walk(placed.drop("key"), config, domain, by="part").accelerations()
    return acted.unionByName(own).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("ax", "ay", "az", "phi")))
