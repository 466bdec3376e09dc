"""Merkle manifest of a table of documents, with proofs by pointer jumping.

Every row is a leaf. The leaves of a source, by doc_id, make a tree of arity ``ARITY``; the subroots of the sources, by name,
make the tree above them. Places come from a range sort: a row's place in its task's range, plus the rows of the ranges
before it, less the place of its source's first row, so that a source with a third of all rows is sorted by many tasks. Then
level by level the nodes of a run are grouped into their parent.

A proof is the siblings from a leaf up to the root. Inner nodes (one for ``ARITY`` leaves or more) hold a pointer to an
ancestor and the segment of siblings towards it, at first their parent and their own siblings. Each round joins the table with
itself: a node takes over its ancestor's pointer and appends its ancestor's segment, so the distance doubles, until every node
reaches the root. The leaves of a run wait in one row and take the segment of their parent at the end, where their own siblings go before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_weight, written

ARITY = 16
#: Ancestors that are broadcast in a round of pointer jumping, each with a segment of about a kilobyte a level.
ANCESTORS = 2_000

_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """How a value goes into a leaf: its bytes' number, a colon and itself; '-' if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _numbered(rows: DataFrame, group: str, order: list[str], heavy_total: int) -> DataFrame:
    """``rows`` with idx (the place in its group by ``order``, from 0) and n (rows of the group). ``group`` has no nulls."""
    laid = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    laid = written(laid.select("*", F.spark_partition_id().alias("__task"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    # one number for each task passes the driver
    sizes = sorted((r["__task"], r["n"]) for r in laid.groupBy("__task").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for task, n in sizes:
        before.append((task, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "__task int, __before long"))
    placed = laid.join(offsets, "__task").withColumn("__place", F.col("__before") + F.col("__at")).drop("__task", "__at", "__before")
    groups = written(placed.groupBy(group).agg(F.min("__place").alias("__first"), F.count("*").alias("n")))
    found = join_by_weight(placed, groups, [group], "n", heavy_total)
    return found.withColumn("idx", F.col("__place") - F.col("__first")).drop("__place", "__first")


def _runs(nodes: DataFrame, child: list[str]) -> DataFrame:
    """Nodes (src, idx, n, ``child``, with the digest h) to their parents: src, idx, n, h and the sorted array ``run``. A lone node is its own parent."""
    run = F.array_sort(F.collect_list(F.struct("idx", *child)))
    met = nodes.groupBy("src", F.floor(F.col("idx") / ARITY).alias("__up")).agg(F.first("n").alias("__n"), run.alias("run"))
    h = F.when(F.col("__n") == 1, F.col("run")[0]["h"]).otherwise(_digest(F.array_join(F.transform("run", lambda c: c["h"]), "")))
    return met.select("src", F.col("__up").alias("idx"), F.ceil(F.col("__n") / ARITY).alias("n"), h.alias("h"), "run", (F.col("__n") == 1).alias("lone"))


def _node(tree: str, level: Column, idx: Column, src: Column) -> Column:
    return F.concat_ws("/", F.lit(tree), level.cast("string"), idx.cast("string"), src)


def _step(run: Column, at: Column) -> Column:
    """The siblings of the child at place ``at`` of ``run``, left to right, and where the child stands among them."""
    others = F.transform(F.filter(run, lambda c: c["idx"] % ARITY != at), lambda c: c["h"])
    return F.array(F.struct(at.alias("at"), F.array_join(others, "").alias("sib")))


def _links(runs: DataFrame, tree: str, level: int, child: Column | None = None) -> DataFrame:
    """The children of ``runs``, which are of ``level`` of ``tree``, with their parent and the step to it."""
    c = runs.where(~F.col("lone")).select("src", "idx", "run", F.explode("run").alias("c"))
    node = _node(tree, F.lit(level - 1), F.col("c.idx"), F.col("src")) if child is None else child
    return c.select(node.alias("node"), _node(tree, F.lit(level), F.col("idx"), F.col("src")).alias("up"), _step(F.col("run"), (F.col("c.idx") % ARITY).cast("int")).alias("seg"))


def _climb(runs: DataFrame, tree: str) -> tuple[DataFrame, DataFrame | None]:
    """From the runs of level 1: src, h and level of each root, and the links of all nodes from level 1 on."""
    roots, links, level = None, None, 1
    while True:
        nodes = runs.select("src", "idx", "n", "h")
        ended = nodes.where("n = 1").select("src", "h", F.lit(level).alias("level"))
        roots = ended if roots is None else roots.unionByName(ended)
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            return roots, links
        level += 1
        runs = written(_runs(nodes, ["h"]))
        more = _links(runs, tree, level)
        links = more if links is None else links.unionByName(more)


def jump(links: DataFrame) -> DataFrame:
    """``links`` (node, up, seg; up is null at the root) to each node's whole segment up to the root."""
    now = written(links)
    while not (below := now.where("up IS NOT NULL")).isEmpty():
        aims = below.select(F.col("up").alias("node")).distinct()
        ends = written(now.join(aims, "node", "left_semi").select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("seg").alias("__seg")))
        if ends.limit(ANCESTORS + 1).count() <= ANCESTORS:
            ends = F.broadcast(ends)
        further = below.join(ends, "up").select("node", F.col("__up").alias("up"), F.concat("seg", "__seg").alias("seg"))
        now = written(further.unionByName(now.where("up IS NULL")))
    return now.select("node", "seg")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, src (the source as a key without nulls, in the order of its bytes), leaf, and tampered: the leaf of the text with A-Z
    in lower case, where 5 divides the CRC-32 of doc_id; else null."""
    text = F.col("text").cast("string")
    leaf = lambda t: _digest(F.concat(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t)]))
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), src.alias("src"), leaf(text).alias("leaf"), F.when(touched, leaf(F.translate(text, _AZ, _AZ.lower()))).alias("tampered"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf gives with the siblings of ``proof``."""
    beside = lambda h, s: _digest(F.concat(F.substring(s["sib"], F.lit(1), 64 * s["at"]), h, F.substring(s["sib"], 64 * s["at"] + 1, F.length(s["sib"]))))
    return F.aggregate(proof, leaf, beside)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A null in any column is its own value, unlike an empty one; a null source is the first, a null doc_id the first of its
    source and never tampered with; rows that repeat a doc_id are ordered by their leaves. A source of one row has that leaf as its
    subroot. Columns other than doc_id, source, lang, n_chars and text are ignored, whatever their names; no rows in, none out.
    """
    made = written(leaves(docs))
    total = made.count()
    placed = _numbered(made, "src", ["doc_id", "leaf"], total)
    bottom = written(_runs(placed.withColumn("h", F.col("leaf")), ["h", "doc_id", "tampered"]))
    subs, inner = _climb(bottom, "source")
    subs = written(subs)
    ranked = _numbered(subs.withColumn("all", F.lit("")), "all", ["src"], subs.count())
    above = written(_runs(ranked.select(F.col("all").alias("src"), "idx", "n", "h", F.col("src").alias("name"), "level"), ["h", "name", "level"]))
    top, over = _climb(above, "top")
    root = top.first()
    own = lambda c: _node("source", F.col(f"{c}level"), F.lit(0), F.col(f"{c}name"))
    nothing = (F.lit(None).cast("string").alias("up"), F.array().cast("array<struct<at:int,sib:string>>").alias("seg"))
    # the root: the top tree's, or the only source's own
    alone = above.where("lone").select(F.explode("run").alias("c")).select(own("c.").alias("node"), *nothing)
    last = top.select(_node("top", F.col("level"), F.lit(0), F.col("src")).alias("node"), *nothing)
    links = _links(above, "top", 1, own("c.")).unionByName(alone).unionByName(last)
    for more in (inner, over):
        links = links if more is None else links.unionByName(more)
    paths = jump(links)
    runs = bottom.groupBy("src").agg(F.count("*").alias("runs")).join(subs.select("src", F.col("h").alias("subroot")), "src")
    known = join_by_weight(bottom.drop("n", "h"), written(runs), ["src"], "runs", bottom.count())
    known = known.withColumn("node", _node("source", F.lit(1), F.col("idx"), F.col("src"))).join(paths, "node")
    rows = known.select("subroot", "run", "lone", "seg", F.explode("run").alias("c"))
    first = F.when(F.col("lone"), nothing[1]).otherwise(_step(F.col("run"), (F.col("c.idx") % ARITY).cast("int")))
    rows = rows.select("c.doc_id", F.col("c.h").alias("leaf"), "c.tampered", "subroot", F.lit(root and root["h"]).alias("root"), F.concat(first, "seg").alias("proof"))
    folded = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    proof = _digest(F.array_join(F.transform("proof", lambda s: s["sib"]), ""))
    return folded.select("doc_id", "leaf", "subroot", F.col("root").cast("string").alias("root"), proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
