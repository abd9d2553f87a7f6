"""Parent links into full hierarchies: splitters, walks to the next splitter, a reduced pointer graph, exact paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import cut
from .skew import LEAST, salted_join

SPLIT = 8  # one node in so many is a splitter


def pointers(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, up): each distinct non-null id of ``nodes`` and its parent, null for a root.

    links: (child, parent). A link counts if both ends are in nodes. Should several parents be stated, the least counts.
    """
    ids = nodes.filter(F.col("id").isNotNull()).select("id").distinct()
    told = links.filter(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct()
    there = salted_join(told.withColumnRenamed("parent", "id"), ids, ["id"], "left_semi").withColumnRenamed("id", "up")
    return ids.join(there.groupBy(F.col("child").alias("id")).agg(F.min("up").alias("up")), "id", "left")


def _jump(walks: DataFrame, paths: bool, least: int) -> tuple[DataFrame, DataFrame]:
    """Walk on until every walk is over: (walks that ended, walks that never do).

    walks: id, to, steps, over and, with paths, via (the nodes from id up to but without ``to``). Each round a walk takes
    on the walk of the node it stands at, so lengths double. In a round in which no walk ends none ever will: on the way
    to an end that is farther there are nodes with every smaller distance, and one of those had ended.
    """
    done, left = walks.filter("over"), walks.filter("not over")
    n = left.count()
    while n:
        at = walks.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("over").alias("_over"), *([F.col("via").alias("_via")] if paths else []))
        on = salted_join(left.drop("over"), at, ["to"], least=least)
        via = [F.concat("via", "_via").alias("via")] if paths else []
        left = cut(on.select("id", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_over").alias("over"), *via))
        walks = done.unionByName(left)
        done, left, before = walks.filter("over"), left.filter("not over"), n
        n = left.count()
        if n == before:
            break
    return done, left


def hierarchy(pointer: DataFrame, paths: bool = False, least: int = LEAST) -> DataFrame:
    """(id, root, depth[, path]) for every node of ``pointers``; root null and depth -1 on a loop or below one.

    Depth counts the links up to the root. path: the ids from the root to the node, null where depth is -1.

    Splitters are the nodes whose hash says so; roots end a walk too. Every node walks to the next splitter above it; the
    splitters alone, one node in eight, form the reduced pointer graph, which is solved in the same way; and each node
    adds what its splitter has. A walk that never meets a splitter or root is in or below a loop without splitters, and a
    splitter that never meets a root in or below a loop with some. Nodes never come to the driver; empty input gives none.
    """
    keep = ["via"] if paths else []
    pointer = cut(pointer)
    splitter = F.pmod(F.xxhash64("id"), F.lit(SPLIT)) == 0
    kinds = pointer.select(F.col("id").alias("up"), (splitter | F.col("up").isNull()).alias("stop"))
    first = salted_join(pointer.filter(F.col("up").isNotNull()), kinds, ["up"], least=least)
    start = cut(first.select("id", F.col("up").alias("to"), F.lit(1).cast("bigint").alias("steps"), F.col("stop").alias("over"), *([F.array("id").alias("via")] if paths else [])))
    walked, endless = _jump(start, paths, least)
    roots = pointer.filter(F.col("up").isNull()).select("id")
    # the reduced graph: a splitter's walk, over where it ends in a root
    of_splitters = walked.filter(F.pmod(F.xxhash64("id"), F.lit(SPLIT)) == 0).select("id", "to", "steps", *keep)
    at_root = roots.select(F.col("id").alias("to"), F.lit(True).alias("over"))
    reduced = cut(salted_join(of_splitters, at_root, ["to"], "left", least).select("id", "to", "steps", F.coalesce("over", F.lit(False)).alias("over"), *keep))
    solved, _ = _jump(reduced, paths, least)
    known = solved.select(F.col("id").alias("to"), F.col("to").alias("root"), F.col("steps").alias("above"), *([F.col("via").alias("_via")] if paths else []))
    known = known.unionByName(roots.select(F.col("id").alias("to"), F.col("id").alias("root"), F.lit(0).cast("bigint").alias("above"), *([F.array().cast("array<string>").alias("_via")] if paths else [])))
    hung = salted_join(walked, known, ["to"], "left", least)
    path = F.when(F.col("root").isNotNull(), F.reverse(F.concat(F.col("via"), F.col("_via"), F.array("root")))) if paths else None
    out = hung.select("id", "root", F.coalesce(F.col("steps") + F.col("above"), F.lit(-1)).alias("depth"), *([path.alias("path")] if paths else []))
    none = [F.lit(None).cast("array<string>").alias("path")] if paths else []
    out = out.unionByName(endless.select("id", F.lit(None).cast("string").alias("root"), F.lit(-1).cast("bigint").alias("depth"), *none))
    return out.unionByName(roots.select("id", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("depth"), *([F.array("id").alias("path")] if paths else [])))


def descendants(with_paths: DataFrame) -> DataFrame:
    """(id, descendant, distance): every pair of a node and one below it, from the exact paths; ``loop_descendants`` has those on and below loops."""
    pairs = with_paths.filter(F.col("path").isNotNull()).select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("place", "id"))
    return pairs.filter(F.col("place") < F.col("depth")).select("id", "descendant", (F.col("depth") - F.col("place")).alias("distance"))


def loop_walks(pointer: DataFrame, endless: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, via): for each id of ``endless``, which are all those on or below a loop, the nodes met on the way up, once each.

    via begins with the node itself and goes on to the loop and once around it. Walks double as in ``_jump``; one is
    over when it stands at a node that it has met, or takes on a walk that is over.
    """
    up = pointer.join(endless.select("id"), "id")
    walks = cut(up.select("id", F.col("up").alias("to"), F.array("id").alias("via"), (F.col("id") == F.col("up")).alias("over")))
    done, left = walks.filter("over"), walks.filter("not over")
    while left.count():
        at = walks.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("via").alias("_via"), F.col("over").alias("_over"))
        on = salted_join(left.drop("over"), at, ["to"], least=least)
        on = on.select("id", F.col("_to").alias("to"), F.array_distinct(F.concat("via", "_via")).alias("via"), "_over")
        left = cut(on.select("id", "to", "via", (F.col("_over") | F.array_contains("via", F.col("to"))).alias("over")))
        walks = done.unionByName(left)
        done, left = walks.filter("over"), left.filter("not over")
    return done.select("id", "via")


def loop_descendants(pointer: DataFrame, endless: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, descendant, distance) for the nodes on and below loops, which ``descendants`` leaves out.

    Nodes below a loop are tops of their subtrees; a node on one has all that is on it or below it, but not itself.
    """
    pairs = loop_walks(pointer, endless, least).select(F.col("id").alias("descendant"), F.posexplode("via").alias("distance", "id"))
    return pairs.filter("distance > 0").select("id", "descendant", F.col("distance").cast("bigint").alias("distance"))


def node_links(node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids and links as text from rows with id, parent and children; null members and empty lists state nothing."""
    up = node.select(F.col("id").alias("child"), "parent")
    down = node.select(F.explode("children").alias("child"), F.col("id").alias("parent"))
    return node.select(F.col("id").cast("string").alias("id")), up.unionByName(down).select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent"))


def officer_links(officer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids (names trimmed, in lower case) and links; a blank boss states nothing."""
    plain = lambda c: F.lower(F.trim(c))
    rows = officer.select(plain("name").alias("child"), F.nullif(plain("boss"), F.lit("")).alias("parent"))
    return rows.select(F.col("child").alias("id")), rows


def _marked(node: DataFrame, officer: DataFrame) -> DataFrame:
    """``pointers`` of both tables in one frame: ids of nodes begin with n:, those of officers with o:."""
    node_ids, links = node_links(node)
    officer_ids, bosses = officer_links(officer)
    mark = lambda df, m: df.select(*[F.concat(F.lit(m), c).alias(c) for c in df.columns])
    return pointers(mark(node_ids, "n:").unionByName(mark(officer_ids, "o:")), mark(links, "n:").unionByName(mark(bosses, "o:")))


def _bare(c):
    return F.substring(c, 3, 1 << 30)


def _named(officer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, id): each officer.name with its marked id, and (id, shown): the least name of an id."""
    names = officer.filter(F.col("name").isNotNull()).select("name", F.concat(F.lit("o:"), F.lower(F.trim("name"))).alias("id")).distinct()
    return names, names.groupBy("id").agg(F.min("name").alias("shown"))


def forest(node: DataFrame, officer: DataFrame, paths: bool = False, least: int = LEAST) -> DataFrame:
    """(src, id, root, depth[, path]) for every distinct node.id and officer.name, solved together in one run.

    Officers whose names differ in case or blanks only are one; each name has a row, and in root and path the least of
    them stands. root is '' where depth is -1.
    """
    tree = hierarchy(_marked(node, officer), paths, least)
    more = ["path"] if paths else []
    path = [F.transform("path", _bare).alias("path")] if paths else []
    nodes = tree.filter(F.col("id").startswith("n:")).select(F.lit("node").alias("src"), _bare("id").alias("id"), F.coalesce(_bare("root"), F.lit("")).alias("root"), "depth", *path)
    names, shown = _named(officer)
    officers = tree.filter(F.col("id").startswith("o:")).join(names, "id")
    officers = salted_join(officers.withColumn("_r", F.col("root")), shown.select(F.col("id").alias("_r"), "shown"), ["_r"], "left", least)
    if paths:
        steps = officers.select("name", F.posexplode("path").alias("place", "_p"))
        said = salted_join(steps, shown.select(F.col("id").alias("_p"), F.col("shown").alias("s")), ["_p"], least=least)
        said = said.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x["s"]).alias("said"))
        officers = officers.join(said, "name", "left").drop("path").withColumnRenamed("said", "path")
    return nodes.unionByName(officers.select(F.lit("officer").alias("src"), F.col("name").alias("id"), F.coalesce("shown", F.lit("")).alias("root"), "depth", *more))


def forest_descendants(node: DataFrame, officer: DataFrame, least: int = LEAST) -> DataFrame:
    """(src, id, descendant, distance) for every distinct node.id and officer.name, solved together in one run.

    Each name of an officer has rows of its own; as descendant the least of its names stands, as in root and path.
    Nodes and officers on and below loops have theirs too, each once and none itself; distance is the least.
    """
    pointer = cut(_marked(node, officer))
    tree = cut(hierarchy(pointer, True, least))
    pairs = cut(descendants(tree).unionByName(loop_descendants(pointer, tree.filter("depth = -1"), least)))
    nodes = pairs.filter(F.col("id").startswith("n:")).select(F.lit("node").alias("src"), _bare("id").alias("id"), _bare("descendant").alias("descendant"), "distance")
    names, shown = _named(officer)
    officers = salted_join(pairs.filter(F.col("id").startswith("o:")), names, ["id"], least=least)
    officers = salted_join(officers, shown.withColumnRenamed("id", "descendant"), ["descendant"], least=least)
    return nodes.unionByName(officers.select(F.lit("officer").alias("src"), F.col("name").alias("id"), F.col("shown").alias("descendant"), "distance"))
