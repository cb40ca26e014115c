"""Parent-child rows to full hierarchies: path, depth, root, descendants, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.skew import heavy_keys
from lodestrata.session import Workspace


def current_nodes(nodes: DataFrame) -> DataFrame:
    """One row (id, parent_id, name) per non-NULL id: that of the greatest mtime, equal ones being repeats.

    A NULL mtime is older than any. Where rows of one mtime differ, the greatest (parent_id, name) holds, so the choice
    never depends on the order of rows. An empty parent_id counts as NULL.
    """
    best = nodes.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("mtime", F.nullif(F.col("parent_id"), F.lit("")).alias("parent_id"), "name")).alias("b"))
    return best.select("id", "b.parent_id", "b.name")


def _doubling(ws: Workspace, links: DataFrame) -> DataFrame:
    """(id, to, steps, least) of nodes outside the reached levels once no further doubling changes anything.

    After k rounds `to` lies 2^k links up, or at the first reached node if that comes before; such a node is not among
    the ids here, so its pointer stays. `least` is the smallest id on the way, the start included. The rounds end when
    all pointers stay, or when (a) the number of distinct moving pointers no longer falls, so that all of them lie on
    cycles, and (b) no `least` changed, so that each covers its whole orbit. Rounds grow with the log of the depth.
    """
    cur, seen = ws.write(links.select("id", F.col("parent_id").alias("to"), F.lit(1).cast("long").alias("steps"), F.col("id").alias("least"))), -1
    while True:
        up = cur.select(F.col("id").alias("u"), F.col("to").alias("to2"), F.col("steps").alias("s2"), F.col("least").alias("l2"))
        nxt = ws.write(
            cur.join(up, F.col("to") == F.col("u"), "left").select(
                "id", F.coalesce("to2", "to").alias("to"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"),
                F.least("least", "l2").alias("least"), F.col("u").isNotNull().alias("moving"), F.coalesce(F.col("l2") < F.col("least"), F.lit(False)).alias("lower"),
            )
        )
        moving, lower, ends = nxt.filter("moving").agg(F.count(F.lit(1)), F.count_if("lower"), F.countDistinct("to")).first()
        ws.drop(cur)
        cur = nxt
        if not moving or (ends == seen and not lower):
            return cur.drop("moving", "lower")
        seen = ends


def _tail_paths(ws: Workspace, links: DataFrame, ancestors: bool) -> DataFrame:
    """(id, to, seg[, mid]) for nodes above which a reached node lies: `to` is that node, seg the names below it,
    mid the ids between. Doubles the segments, so the rounds grow with the log of the depth."""
    cur = ws.write(links.select("id", F.col("parent_id").alias("to"), F.col("name").alias("seg"), *([F.expr("CAST(array() AS ARRAY<STRING>) AS mid")] if ancestors else [])))
    while True:
        up = cur.select(F.col("id").alias("u"), F.col("to").alias("to2"), F.col("seg").alias("seg2"), *([F.col("mid").alias("mid2")] if ancestors else []))
        hit = F.col("u").isNotNull()
        nxt = ws.write(
            cur.join(up, F.col("to") == F.col("u"), "left").select(
                "id", F.coalesce("to2", "to").alias("to"), F.when(hit, F.concat("seg2", F.lit("/"), "seg")).otherwise(F.col("seg")).alias("seg"), hit.alias("moving"),
                *([F.when(hit, F.concat("mid2", F.array("to"), "mid")).otherwise(F.col("mid")).alias("mid")] if ancestors else []),
            )
        )
        more = nxt.filter("moving").limit(1).count()
        ws.drop(cur)
        cur = nxt
        if not more:
            return cur.drop("moving")


def hierarchy(nodes: DataFrame, ancestors: bool = False, levels_per_step: int = 4, wide_steps: int = 3, salts: int = 32) -> DataFrame:
    """Every distinct node id with root_id, depth, path (names from the root, joined by '/') and, if asked, ancestors.

    Level-wise frontier joins: roots (no parent, or one that is no node) form level 0; each level joins the frontier's
    ids with the parent ids of nodes not yet reached, `levels_per_step` levels to a job; parents with very many children
    are salted. After `wide_steps` such jobs the few nodes of deeper levels reach the known ones by doubling their links,
    which takes a number of jobs that grows with the log of the depth, not with the depth; what never gets there hangs on a cycle: depth -1, root_id the
    smallest id on it, path and ancestors NULL. A NULL name counts as empty. `ancestors` is the array of ids from the
    root down to the parent. A table without rows gives none.
    """
    ws = Workspace(nodes.sparkSession, "hierarchy")
    cur = ws.write(current_nodes(nodes))
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    name = F.coalesce("name", F.lit(""))
    # parents with a fiftieth of all nodes right below them (50 at most): their children get a salt, they themselves a row
    # per salt, marked once and for all; roots without a parent take no part in any join
    children = cur.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    heavy = [r[0] for r in heavy_keys(children, "parent_id", "n", cur.count(), 0.02).collect()]
    salt = F.when(F.col("parent_id").isin(heavy), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0)).cast("int")

    def parents(level: DataFrame) -> DataFrame:
        """level under the names parent_id, salt and p_..., once per salt where many children will ask for it."""
        copies = F.explode(F.when(F.col("id").isin(heavy), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
        return level.select(F.col("id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in level.columns if c != "id"], copies.alias("salt") if heavy else F.lit(0).alias("salt"))

    named = cur.filter(F.col("parent_id").isNotNull()).select("id", "parent_id", name.alias("name"), salt.alias("salt"))
    rest = ws.write(named.join(parents(cur.select("id")), ["parent_id", "salt"]).select("id", "parent_id", "name", "salt"))
    top = cur.filter(F.col("parent_id").isNull()).select("id", name.alias("name")).unionByName(named.join(parents(cur.select("id")), ["parent_id", "salt"], "left_anti").select("id", "name"))
    front = ws.write(top.select("id", F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"), F.col("name").alias("path"), *([none.alias("ancestors")] if ancestors else [])))
    ws.drop(cur)
    done, left = [front], rest.count()
    for _ in range(wide_steps):
        if not left:
            break
        level, out = front, None
        for _ in range(levels_per_step):
            level = rest.join(parents(level), ["parent_id", "salt"]).select(
                "id", F.col("p_root_id").alias("root_id"), (F.col("p_depth") + 1).alias("depth"), F.concat("p_path", F.lit("/"), "name").alias("path"),
                *([F.concat("p_ancestors", F.array("parent_id")).alias("ancestors")] if ancestors else []),
            )
            out = level if out is None else out.unionByName(level)
        out = ws.write(out)
        n, deepest = out.agg(F.count(F.lit(1)), F.max("depth")).first()
        if not n:
            break
        done.append(out)
        front = out.filter(F.col("depth") == deepest)
        fewer = ws.write(rest.join(out.select(F.col("id").alias("r")), F.col("id") == F.col("r"), "left_anti"))
        ws.drop(rest)
        rest, left = fewer, left - n
    res = done[0]
    for d in done[1:]:
        res = res.unionByName(d)
    if not left:
        return res
    ends = _doubling(ws, rest)
    inside = ends.select(F.col("id").alias("u"), F.col("least").alias("cycle_root"))
    ends = ws.write(ends.join(inside, F.col("to") == F.col("u"), "left"))
    cyclic = ends.filter(F.col("u").isNotNull())
    res = res.unionByName(cyclic.select("id", F.col("cycle_root").alias("root_id"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("string").alias("path"), *([F.lit(None).cast("array<string>").alias("ancestors")] if ancestors else [])))
    deep = ends.filter(F.col("u").isNull()).select("id", "steps")
    tails = _tail_paths(ws, rest.join(deep.select("id"), "id", "left_semi"), ancestors).join(deep, "id")
    top = done[-1].select(F.col("id").alias("top_id"), "root_id", F.col("depth").alias("d"), F.col("path").alias("p"), *([F.col("ancestors").alias("a")] if ancestors else []))
    for d in done[:-1]:
        top = top.unionByName(d.select(F.col("id").alias("top_id"), "root_id", F.col("depth").alias("d"), F.col("path").alias("p"), *([F.col("ancestors").alias("a")] if ancestors else [])))
    deeper = tails.join(top, F.col("to") == F.col("top_id")).select(
        "id", "root_id", (F.col("d") + F.col("steps")).alias("depth"), F.concat("p", F.lit("/"), "seg").alias("path"),
        *([F.concat("a", F.array("to"), "mid").alias("ancestors")] if ancestors else []),
    )
    return res.unionByName(deeper)


def descendants(nodes: DataFrame) -> DataFrame:
    """Ancestor pairs (id, descendant_id, distance): every node with each node below it. Nodes on or under a cycle have none.

    Each node emits its own ancestors, so no group of a root's descendants is ever collected in one place.
    """
    h = hierarchy(nodes, ancestors=True)
    return h.select(F.col("id").alias("descendant_id"), "depth", F.posexplode("ancestors").alias("pos", "id")).select("id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))
