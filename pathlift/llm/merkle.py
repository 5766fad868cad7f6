"""A Merkle manifest of a table: one ternary tree per group, one tree over the groups, and proofs by a recursive query.

Rows get exact places by range numbering. Levels are built from the leaves up and stored as node rows: each knows the
siblings beside it on the next few levels and the key of the node they lead to (its parent link). A recursive query
climbs from the leaves along these links, appends the siblings it passes and folds them into a claimed leaf digest of
every leaf, up to the root.

One node row spans ``STRIDE`` levels, so a climb of 40 levels takes ten joins. Neighbouring leaves lead to the same
nodes: a row of the climb is a block of them, with a digest folded for each and the siblings they share held once, so
Spark, which shuffles every round of a recursion, moves little more than the digests. Nodes above many leaves are stored in
copies of which every block uses one by a hash: no key of the climb's join holds more than about ``LEAVES_A_COPY`` leaves,
the root's included.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathlift.operators.ranking import numbered

from .common import cut_lineage

RUN, STRIDE, LEAVES_A_COPY = 3, 4, 6_561
#: Where a group's tree ends: the hop number under which the tree over the groups keeps that group.
LEAF_OF_TOP = -1
TOP = ""


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def framed(column: str) -> Column:
    """The value with its UTF-8 byte count in front, or a hyphen for null."""
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    """Digest of the framed values of a row; ``changed`` gives other framed values for some columns."""
    return digest(F.concat(*[(changed or {}).get(c, framed(c)) for c in columns]))


@dataclass
class Manifest:
    """``blocks``: neighbouring leaves with their first steps and the link they share; ``nodes``: the rows above."""

    blocks: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def _above(nodes: Column) -> Column:
    """The digests one level up."""
    runs = F.ceil(F.size(nodes) / RUN).cast("int")
    return F.transform(F.sequence(F.lit(0), runs - 1), lambda r: digest(F.array_join(F.slice(nodes, r * RUN + 1, RUN), "")))


def _joined(nodes: Column, start: Column, length: Column) -> Column:
    """Part of a list of digests as bytes, half the size of their text."""
    return F.unhex(F.array_join(F.slice(nodes, start.cast("int"), length.cast("int")), ""))


def _blocks(rows: DataFrame, stride: int) -> DataFrame:
    """One row per block of RUN ** stride neighbours: what lies above them, and the steps of each up to there.

    ``rows``: tree, pos, hash, n (nodes of the tree on this level), beneath (leaves below the node), own (carried).
    """
    width = RUN**stride
    blocks = rows.groupBy("tree", F.expr(f"pos div {width}L").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "hash", "beneath", "own"))).alias("m"),
        F.max("n").alias("n"), F.sum("beneath").alias("beneath"))
    # A level is climbed while the whole tree has more than one node on it.
    climbed = sum((F.col("n") > RUN**level).cast("int") for level in range(stride))
    blocks = blocks.withColumns({"levels": climbed, "l0": F.transform("m", lambda x: x["hash"])})
    for level in range(1, stride + 1):
        blocks = blocks.withColumn(f"l{level}", _above(F.col(f"l{level - 1}")))

    def step(level: int, i: Column) -> Column:
        nodes, place = F.col(f"l{level}"), F.floor(i / RUN**level)
        within = place % RUN
        return F.struct(
            _joined(nodes, place - within + 1, within).alias("left"),
            _joined(nodes, place + 2, F.lit(RUN - 1) - within).alias("right"))

    members = F.transform("m", lambda x, i: F.struct(
        x["pos"].alias("pos"), x["hash"].alias("hash"), x["beneath"].alias("beneath"), x["own"].alias("own"),
        F.slice(F.array(*[step(level, i) for level in range(stride)]), 1, F.col("levels")).alias("steps")))
    tops = F.array(*[F.element_at(f"l{level}", 1) for level in range(stride + 1)])
    return blocks.select(
        "tree", "block", "n", "beneath", members.alias("members"), F.element_at(tops, F.col("levels") + 1).alias("top"),
        (F.col("n") <= width).alias("done"))


def _copies(beneath: Column) -> Column:
    return F.ceil(beneath / LEAVES_A_COPY).cast("long")


def _linked(blocks: DataFrame, hop: int, is_top: bool) -> DataFrame:
    """Blocks with the link to the node above them: (up_tree, up_hop, up_pos, up_copies)."""
    done = F.col("done")
    if is_top:  # above the last node there is nothing
        tree, at, pos = F.when(~done, F.lit(TOP)), F.lit(hop + 1), F.col("block")
    else:
        tree = F.col("tree")
        at, pos = F.when(done, LEAF_OF_TOP).otherwise(hop + 1), F.when(done, F.lit(0)).otherwise(F.col("block"))
    return blocks.withColumns({
        "hop": F.lit(hop), "up_tree": tree, "up_hop": at.cast("int"), "up_pos": pos.cast("long"),
        "up_copies": _copies(F.col("beneath"))})


def _single(linked: DataFrame) -> DataFrame:
    """The members of linked blocks as rows of their own."""
    return linked.select("tree", "hop", F.explode("members").alias("m"), "up_tree", "up_hop", "up_pos", "up_copies").select(
        "tree", "hop", "m.*", "up_tree", "up_hop", "up_pos", "up_copies")


def _grown(rows: DataFrame, largest: int, stride: int, is_top: bool) -> tuple[list[DataFrame], DataFrame]:
    """Every hop's linked blocks, from the leaves up, and the last nodes (tree, top, beneath) of all trees."""
    hops, ended = [], []
    hop, width = 0, RUN**stride
    while True:
        blocks = cut_lineage(_blocks(rows, stride))
        hops.append(_linked(blocks, hop, is_top))
        ended.append(blocks.where("done").select("tree", "top", "beneath"))
        if largest <= width:
            break
        rows = blocks.where("not done").select(
            "tree", F.col("block").alias("pos"), F.col("top").alias("hash"),
            F.ceil(F.col("n") / width).cast("long").alias("n"), "beneath", F.lit(None).cast("string").alias("own"))
        hop, largest = hop + 1, -(-largest // width)
    last = ended[0]
    for more in ended[1:]:
        last = last.unionByName(more)
    return hops, last


def _copied(rows: DataFrame) -> DataFrame:
    """One row for each copy of a node."""
    copies = F.explode(F.sequence(F.lit(0).cast("long"), _copies(F.col("beneath")) - 1))
    return rows.select(
        "tree", "hop", "pos", copies.alias("copy"), "hash", "steps", "up_tree", "up_hop", "up_pos", "up_copies")


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf", stride: int = STRIDE) -> Manifest:
    """Trees over all rows: within each group by ``order``, over the groups by their value, null first.

    ``group`` is compared byte by byte as text. Rows equal in the whole order follow each other by their digest; null
    comes first. Without rows there are no nodes and no root.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    keyed = rows.select(
        tree.alias("tree"), F.col(leaf).alias("hash"), F.struct(*[F.col(c) for c in rows.columns]).alias("own"))
    by = [F.col(f"own.{c}").asc_nulls_first() for c in order]
    leaves = numbered(keyed, [*by, F.col("hash")], by=["tree"], into="pos", size_into="n").withColumn(
        "beneath", F.lit(1).cast("long"))
    leaves = cut_lineage(leaves)
    hops, subroots = _grown(leaves, leaves.agg(F.max("n")).first()[0] or 1, stride, is_top=False)
    trees = cut_lineage(numbered(subroots, [F.col("tree")], into="pos", size_into="n"))
    top_rows = trees.select("tree", "pos", F.col("top").alias("hash"), "n", "beneath").select(
        F.lit(TOP).alias("tree"), "pos", "hash", "n", "beneath", F.col("tree").alias("own"))
    top_hops, root = _grown(top_rows, trees.agg(F.max("n")).first()[0] or 1, stride, is_top=True)
    # The lowest nodes of the upper tree are found under the group they stand for.
    nodes = _copied(_single(top_hops[0]).withColumns(
        {"tree": F.col("own"), "hop": F.lit(LEAF_OF_TOP), "pos": F.lit(0).cast("long")}))
    for above in [*hops[1:], *top_hops[1:]]:
        nodes = nodes.unionByName(_copied(_single(above)))
    found = root.first()
    value = F.when(F.col("tree") != "-", F.substring("tree", 2, 2**31 - 1))
    return Manifest(hops[0], cut_lineage(nodes), trees.select(value.alias(group), F.col("top").alias("subroot")),
                    found.top if found else None)


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    """Spark stops recursive queries at a million rows unless told that they are meant to be large."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_FOLD = "aggregate({steps}, {start}, (a, s) -> sha2(concat(lower(hex(s.left)), a, lower(hex(s.right))), 256))"
_SIBLINGS = "aggregate({steps}, {start}, (a, s) -> concat(a, s.left, s.right))"

CLIMB = f"""
WITH RECURSIVE climb(tree, block, up_tree, up_hop, up_pos, up_copy, subroot, folded, siblings) AS (
  SELECT b.tree, b.block, b.up_tree, b.up_hop, b.up_pos, pmod(xxhash64(b.tree, b.block), b.up_copies), CAST(NULL AS STRING),
         transform(b.members, m -> {_FOLD.format(steps='m.steps', start='m.own.CLAIM')}), X''
  FROM {{blocks}} b
  UNION ALL
  SELECT c.tree, c.block, n.up_tree, n.up_hop, n.up_pos, pmod(xxhash64(c.tree, c.block), n.up_copies),
         coalesce(c.subroot, CASE WHEN n.hop = {LEAF_OF_TOP} THEN n.hash END),
         transform(c.folded, f -> {_FOLD.format(steps='n.steps', start='f')}),
         {_SIBLINGS.format(steps='n.steps', start='c.siblings')}
  FROM climb c JOIN {{nodes}} n
    ON n.tree = c.up_tree AND n.hop = c.up_hop AND n.pos = c.up_pos AND n.copy = c.up_copy)
SELECT tree, block, subroot, folded, siblings FROM climb WHERE up_tree IS NULL"""


def climbed(found: Manifest, claim: str) -> DataFrame:
    """Every row's own columns, subroot, root, proof_sha256, and folded_root: what the digest in ``claim`` leads to."""
    spark = found.blocks.sparkSession
    with _any_number_of_rows(spark):
        tops = cut_lineage(spark.sql(CLIMB.replace("CLAIM", f"`{claim}`"), blocks=found.blocks, nodes=found.nodes))
    each = found.blocks.select("tree", "block", "members").join(tops, ["tree", "block"]).select(
        "subroot", "siblings", F.explode(F.arrays_zip("members", "folded")).alias("x"))
    proof = F.expr(_SIBLINGS.format(steps="x.members.steps", start="X''"))
    return each.select(
        "x.members.own.*", "subroot", F.lit(found.root).cast("string").alias("root"),
        digest(F.lower(F.hex(F.concat(proof, F.col("siblings"))))).alias("proof_sha256"), F.col("x.folded").alias("folded_root"))


def tamper_proofs(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
                  group: str = "source", order: str = "doc_id", text: str = "text", stride: int = STRIDE) -> DataFrame:
    """The manifest of a table put to the test: every second row, by the crc32 of its id, loses its line breaks.

    Per row: the id, leaf, subroot, root and proof of the table as it is, the root its own (perhaps changed) leaf
    folds to, and whether they agree. Null values are framed as a hyphen, so null and empty text differ; a row whose
    id is null isn't changed and comes first in its group, as the group of the null source comes first. Repeated rows
    are leaves of their own beside each other. A text of any length is hashed whole. An empty table gives no rows.
    Columns other than ``columns`` are ignored.
    """
    even = F.coalesce(F.crc32(F.col(order).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    emptied = F.replace(F.col(text), F.lit("\n"), F.lit(""))
    broken = even & F.col(text).contains("\n")
    changed = F.coalesce(F.concat(F.octet_length(emptied).cast("string"), F.lit(":"), emptied), F.lit("-"))
    rows = docs.select(
        F.col(order).alias("id"), F.col(group).alias("group"), leaf_digest(columns).alias("leaf"),
        F.when(broken, leaf_digest(columns, {text: changed})).alias("tampered"))
    rows = rows.withColumn("claimed", F.coalesce("tampered", "leaf")).drop("tampered")
    found = climbed(manifest(rows, "group", ["id"], stride=stride), "claimed")
    return found.select(
        F.col("id").alias(order), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
