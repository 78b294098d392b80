"""Operator 11: Merkle dataset manifest with proofs, by butterfly exchange.

Rows are leaves; the leaves of a tree (here: a source) stand in order, and
every ``FANOUT`` consecutive nodes become their hash until one is left.  The
leaves are dealt into aligned blocks of ``FANOUT ** BLOCK_LEVELS``.  A block
hashes its own subtree; then blocks whose numbers differ only in one digit to
the base ``FANOUT`` swap subtree roots, digit by digit.  Every member of such
a group hashes the same ancestor, so after the last round each block knows its
root and all siblings on the way up: nothing is sent down again.  The last
subtree of a tree may hold fewer blocks than its siblings; its blocks then
send their root to the places that have no partner of their own.

The subtree roots of all trees are the leaves of one more tree, which takes
the same exchange.  Positions come from one range-partitioned sort and counts
by (partition, tree), so a tree that holds most rows is spread like any other.
All steps are DataFrame expressions; a group never holds more rows than a
block or a fanout, and the driver sees two counts.

Defined results: a null field of a leaf is ``-``; null ``source`` is a tree of
its own, before all others; leaves ascend by doc_id (null first), ties by leaf
hash; repeated rows are leaves each; an empty table gives an empty manifest;
texts of any length are hashed whole, once; other columns are left out unless
named in ``carry``, and a carried column must not have the name of an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.llm.common import ready, small_side, written

FANOUT = 3
BLOCK_LEVELS = 6           # a block holds 3 ** 6 = 729 leaves
ROUNDS_A_TABLE = 5         # exchange rounds planned before the lineage is cut
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(columns: dict[str, Column] | None = None) -> Column:
    """Hash of a row's fields, each ``-`` or byte count, colon and value;
    ``columns`` replaces some of them."""
    parts = []
    for name in FIELDS:
        c = (columns or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves until one node is left, in integers."""
    powers = F.array(*[F.lit(FANOUT ** i) for i in range(40)])
    return F.size(F.filter(powers, lambda p: p < n))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (0, 1, ... by ``order`` inside each ``tree``) and
    ``n`` (rows of the tree).  ``tree`` must not be null."""
    ranged = written(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
                     .withColumn("_row", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_part", F.shiftright("_row", 33))
    # at most (partitions + trees) rows
    runs = ranged.groupBy("_part", tree).agg(F.count("*").alias("_k"), F.min("_row").alias("_from"))
    w = Window.partitionBy(tree)
    runs = runs.select("_part", tree, F.sum("_k").over(w).alias("n"),
                       (F.sum("_k").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
                       "_from")
    runs = written(runs.withColumn("_before", F.coalesce("_before", F.lit(0))), "runs")
    return (ranged.join(small_side(runs, 96), ["_part", tree])
            .withColumn("pos", F.col("_before") + F.col("_row") - F.col("_from"))
            .drop("_part", "_row", "_before", "_from"))


def _node(children: Column) -> Column:
    return F.sha2(F.concat_ws("", children), 256)


def exchanged(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, b, n, node: node ``b`` of the ``n`` of a tree) with the
    tree's ``root`` and ``above``, the siblings on the way, by butterfly
    exchange.  Each item of ``above`` is (left, right): the hashes of the
    siblings before and after, joined."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    at = nodes.select("tree", "b", "n", F.col("node").alias("root"),
                      F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("above"))
    rounds, span = 0, 1
    while span < most:
        at = _round(at, span)
        span *= FANOUT
        rounds += 1
        if rounds % ROUNDS_A_TABLE == 0:
            at = written(at, "butterfly")
    return at.drop("n")


def _round(at: DataFrame, span: int) -> DataFrame:
    """One round: subtrees of ``span`` nodes swap roots in groups of FANOUT."""
    parent, place = F.expr(f"b div {span * FANOUT}"), F.expr(f"b div {span} % {FANOUT}")
    off = F.col("b") % span
    here = F.least(F.lit(span), F.col("n") - F.expr(f"b div {span}") * span)    # nodes of this subtree
    # a tree that is whole already keeps its root and meets nobody
    whole = F.col("n") <= span
    seats = F.when(whole | (here >= span) | (place == 0), F.array(off)).otherwise(
        F.sequence(off, F.lit(span - 1).cast("long"), here))
    sent = at.select("tree", parent.alias("parent"), F.explode(seats).alias("seat"), off.alias("off"), whole.alias("whole"),
                     F.struct(place.alias("place"), "b", "n", "root", "above").alias("sent"))
    group = sent.groupBy("tree", "whole", "parent", "seat").agg(
        F.sort_array(F.collect_list(F.struct(F.col("sent.place").alias("place"), (F.col("off") == F.col("seat")).alias("own"),
                                             F.col("sent").alias("it")))).alias("g"))
    roots = F.transform("g", lambda x: x["it"]["root"])

    def joined(i, of):
        return F.concat_ws("", F.transform(F.filter("g", lambda y: of(y["place"], i)), lambda y: y["it"]["root"]))

    members = F.transform(F.filter("g", lambda x: x["own"]), lambda x: F.struct(
        x["it"]["b"].alias("b"), x["it"]["n"].alias("n"),
        F.when(F.col("whole"), x["it"]["root"]).otherwise(F.col("up")).alias("root"),
        F.when(F.col("whole"), x["it"]["above"]).otherwise(F.concat(x["it"]["above"], F.array(F.struct(
            joined(x["place"], lambda a, b: a < b).alias("left"),
            joined(x["place"], lambda a, b: a > b).alias("right"))))).alias("above")))
    return group.withColumn("up", _node(roots)).select("tree", F.inline(members))


def _subtree(leaves: Column, levels: Column) -> Column:
    """The levels of a block: its leaves, then the nodes above, up to ``levels``."""
    def grow(acc, _):
        last = F.element_at(acc, -1)
        step = F.transform(F.sequence(F.lit(0), (F.size(last) - 1).cast("int"), F.lit(FANOUT)),
                           lambda i: _node(F.array(*[F.get(last, i + j) for j in range(FANOUT)])))
        return F.concat(acc, F.array(step))
    # a sequence from 1 to 0 would run backwards
    turns = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(turns, F.array(leaves), grow)


def _siblings(tree: Column, i: Column) -> Column:
    """Siblings of leaf ``i`` on every level of a block below its root."""
    widths = F.array(*[F.lit(FANOUT ** k) for k in range(BLOCK_LEVELS + 1)])

    def at(level):
        row = F.get(tree, level)
        k = F.floor(i / F.get(widths, level)).cast("int")
        first = k - k % FANOUT

        def side(before):
            return F.concat_ws("", *[F.when((first + j < k) if before else (first + j > k), F.get(row, first + j))
                                     for j in range(FANOUT)])
        return F.struct(side(True).alias("left"), side(False).alias("right"))
    top = F.size(tree) - 2
    return F.when(top >= 0, F.transform(F.sequence(F.lit(0), top), at)).otherwise(
        F.expr("cast(array() as array<struct<left:string,right:string>>)"))


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, leaf, the ``carry`` columns,
    pos and n (place among the leaves of its source), subroot, root and proof:
    (left, right) per level, hashes of the siblings before and after, from the
    leaf by the subroot to the root."""
    ready(docs.sparkSession)
    extra = list(carry or {})
    rows = docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"),
                       leaf_hash().alias("leaf"), *[c.alias(k) for k, c in (carry or {}).items()])
    size = FANOUT ** BLOCK_LEVELS
    leaves = numbered(rows, "tree", ["doc_id", "leaf"])
    blocks = written(
        leaves.groupBy("tree", F.expr(f"pos div {size}").alias("b"))
        .agg(F.first("source").alias("source"), F.first("n").alias("n"),
             F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", *extra))).alias("rows"))
        .withColumn("levels", _subtree(F.transform("rows", lambda r: r["leaf"]),
                                       F.least(F.lit(BLOCK_LEVELS), _height(F.col("n")))))
        .withColumn("node", F.element_at(F.element_at("levels", -1), 1)), "blocks")
    up = written(exchanged(blocks.select("tree", "b", "node", F.ceil(F.col("n") / size).alias("n"))), "upper")
    # the roots of all trees are the leaves of the last one
    roots = up.where("b = 0").select(F.lit(0).alias("all"), "tree", F.col("root").alias("subroot"))
    top = numbered(roots, "all", ["tree"])
    top = written(exchanged(top.select(F.col("all").alias("tree"), F.col("pos").alias("b"), "n", F.col("subroot").alias("node")))
                  .select("b", "root", F.col("above").alias("last"))
                  .join(top.select(F.col("pos").alias("b"), "tree"), "b").drop("b"), "top")
    upper = written(up.withColumnRenamed("root", "subroot").join(small_side(top, 4096), "tree"), "proofs")
    parts = blocks.join(small_side(upper, 8192), ["tree", "b"])
    each = F.transform("rows", lambda r, i: F.struct(
        r["doc_id"].alias("doc_id"), r["leaf"].alias("leaf"), *[r[k].alias(k) for k in extra], r["pos"].alias("pos"),
        _siblings(F.col("levels"), i).alias("low")))
    return (parts.select("source", "n", "subroot", "root", "above", "last", F.inline(each))
            .select("doc_id", "source", "leaf", *extra, "pos", "n", "subroot", "root",
                    F.concat("low", "above", "last").alias("proof")))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def manifest_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of the rows as they are;
    folded_root and verified of the rows after tampering (line ends deleted
    where 2 divides the crc32 of doc_id)."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    tampered = F.when(hit, leaf_hash({"text": F.translate("text", "\n", "")})).otherwise(leaf_hash())
    rows = manifest(docs.select(*FIELDS), {"claimed": tampered})
    return (rows.withColumn("folded_root", folded(F.col("claimed"), F.col("proof")))
            .select("doc_id", "leaf", "subroot", "root",
                    F.sha2(F.concat_ws("", F.transform("proof", lambda p: F.concat(p["left"], p["right"]))), 256)
                    .alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))
