"""Merkle manifest of a dataset, by slot pivots.

Each row is a leaf: the SHA-256 of its fields. The leaves of a group (one
source, say) are numbered in order; every ``fanout`` consecutive nodes have one
parent. A level is one group-by of (group, number div fanout): conditional
aggregates spread the children into ``fanout`` slot columns. All columns
concatenated and hashed are the parent; the columns without a child's own slot
are its siblings. Levels follow until each group has one node, its subroot;
the subroots, in the order of their groups, are the leaves of one more such
tree, whose last node is the root.

Proofs come from the top down. The steps from a node to the root (its siblings
on the left and on the right, level by level) are shared by all leaves below
it, so they are carried by the pivoted parents, one row for ``fanout`` children,
and a leaf adds only its own step. A level is one join of parents with parents;
whole paths never travel with the leaves.

Numbers within a group need no task that holds a group: rows are dealt into
ranges of (group, order), a range numbers its rows, and the rows that a group
has in earlier ranges are added from a table of one row for each group and
range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cxlens.llm.common import written

FANOUT = 16
#: The fields of a document in its leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a partition that ``monotonically_increasing_id`` can number, in bits.
_ROW_BITS = 33


def sha(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of strings one after the other (nulls are nothing)."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """A value in a leaf: ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return sha(*map(field, values))


def group_key(value: Column) -> Column:
    """A string that is never null and sorts as the value does by its UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``idx``, their number from 0 within the (non-null) group, and ``size``, the group's rows; written.

    Rows equal in all of ``order`` may be numbered either way. A salt after them keeps
    many equal rows from one task.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [group, *order, "_salt"]
    dealt = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.drop("_salt").withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", _ROW_BITS)), "merkle-ranges")
    pieces = dealt.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    in_group = Window.partitionBy(group)  # one row for each range at most
    before = F.coalesce(F.sum("_n").over(in_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(in_group).alias("size"))
    out = dealt.join(pieces, [group, "_range"]).withColumn("idx", F.col("_at") + F.col("_shift"))
    return written(out.drop("_at", "_range", "_shift"), "merkle-numbered")


def _merged(rows: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join by sorting. Spark would choose a broadcast by the size of the files, and paths, whose steps repeat
    each other's digests, take far more memory there (and 16 times that as children) than compressed on disk.
    """
    return rows.join(other.hint("merge"), on)


def _slots(fanout: int) -> list[str]:
    return [f"c{k}" for k in range(fanout)]


def pivoted(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents of nodes (grp, idx, size, digest): (grp, idx, size) of the parent level, and the children in slot columns."""
    slot = F.pmod("idx", F.lit(fanout))
    children = [F.max(F.when(slot == k, F.col("digest"))).alias(c) for k, c in enumerate(_slots(fanout))]
    return nodes.groupBy("grp", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("size") / fanout).alias("size")).agg(*children)


def siblings(slot: Column, fanout: int) -> Column:
    """The step of the child in ``slot``: its siblings on the left and on the right."""
    return F.struct(*[F.concat_ws("", *[F.when(side(k), F.col(c)) for k, c in enumerate(_slots(fanout))]).alias(name)
                      for name, side in (("left", lambda k: slot > k), ("right", lambda k: slot < k))])


def tree(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The pivoted levels of every group's tree, and (grp, digest) of the groups' last nodes.

    ``leaves``: grp, idx, size and digest.
    """
    nodes, levels, tops = leaves.select("grp", "idx", "size", "digest"), [], []
    most = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        tops.append(nodes.where("size = 1").select("grp", "digest"))
        if most <= 1:
            return levels, reduce(DataFrame.union, tops)
        parents = written(pivoted(nodes.where("size > 1"), fanout), "merkle-level")
        levels.append(parents)
        nodes = parents.select("grp", "idx", "size", sha(*map(F.col, _slots(fanout))).alias("digest"))
        most = -(-most // fanout)


def with_paths(levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame | None:
    """The lowest parents with ``path``, the steps from the parent itself to the root, and what else ``above`` has.

    ``above``: for each grp the ``path`` of its last node, and further columns to hand down.
    """
    more, lower = [c for c in above.columns if c not in ("grp", "path")], None
    for parents in reversed(levels):
        done = _merged(parents.where("size = 1"), above, ["grp"])
        if lower is None:
            lower = done
        else:
            child = F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("k")
            handed = lower.select("*", child).select(
                "grp", (F.col("idx") * fanout + F.col("k")).alias("idx"), F.concat(F.array(siblings(F.col("k"), fanout)), "path").alias("path"), *more)
            lower = done.unionByName(_merged(parents.where("size > 1"), handed, ["grp", "idx"]))
        lower = written(lower, "merkle-paths")
    return lower


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id", fanout: int = FANOUT,
             carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, ``steps`` (array of (left, right) siblings from leaf to root) and the carried columns.

    ``carry``: further columns by name, as expressions over ``docs``.

    A null field is ``-``, an empty text ``0:``, texts of any length count whole; a null group is a group of its
    own and the first. Leaves ascend by key, null keys first, rows of one key by their digest; equal
    rows are equal leaves side by side, each with its own place. Other columns are not read. An empty table gives an empty
    result.
    """
    carry = dict(carry or {})
    leaves = docs.select(F.col(key).alias("doc_id"), group_key(F.col(group)).alias("grp"), leaf_digest([F.col(f) for f in fields]).alias("digest"),
                         F.struct(*[e.alias(n) for n, e in carry.items()]).alias("carried") if carry else F.lit(None).cast("boolean").alias("carried"))
    leaves = numbered(written(leaves, "merkle-leaves"), "grp", ["doc_id", "digest"])
    levels, subroots = tree(leaves, fanout)

    # The groups' own tree: one group of all subroots.
    subroots = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), "grp", ["of"])
    upper, last = tree(subroots, fanout)
    root = last.first()
    root = F.lit(root["digest"] if root else None).cast("string")
    no_steps = F.array().cast("array<struct<left:string,right:string>>")
    tops = with_paths(upper, last.select("grp", no_steps.alias("path")), fanout)
    above = _placed(subroots.select("grp", "idx", "size", "of", F.col("digest").alias("subroot")), tops, no_steps, fanout)
    above = written(above.select(F.col("of").alias("grp"), F.col("steps").alias("path"), "subroot"), "merkle-groups")

    lowest = with_paths(levels, above, fanout)
    several = leaves.where("size > 1")
    placed = _placed(several, lowest, no_steps, fanout) if lowest is not None else several.select("*", no_steps.alias("steps"), F.lit("").alias("subroot"))
    alone = _merged(leaves.where("size = 1"), above.withColumnRenamed("path", "steps"), ["grp"])
    columns = ["doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "steps", *[F.col("carried")[n].alias(n) for n in carry]]
    return placed.select(*columns).unionByName(alone.select(*columns))


def _placed(nodes: DataFrame, parents: DataFrame | None, no_steps: Column, fanout: int) -> DataFrame:
    """Nodes (grp, idx, ...) with their ``steps``, their own and those of their parent in ``parents`` (none: a lone node)."""
    if parents is None:
        return nodes.withColumn("steps", no_steps)
    up = parents.drop("size").withColumnRenamed("idx", "parent")
    out = _merged(nodes.withColumn("parent", F.floor(F.col("idx") / fanout)), up, ["grp", "parent"])
    return out.withColumn("steps", F.concat(F.array(siblings(F.pmod("idx", F.lit(fanout)), fanout)), "path")).drop("parent", "path", *_slots(fanout))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings from leaf to root, left to right."""
    return sha(F.transform(steps, lambda s: F.concat(s["left"], s["right"])))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda node, s: sha(s["left"], node, s["right"]))


#: ASCII letters that tampering lower-cases, and what they become.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAMPER_EVERY = 5


def tamper_report(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` and how tampered documents fail against it.

    Tampered is where ``TAMPER_EVERY`` divides the crc32 of the decimal doc_id (a null one: never): there
    the text's A-Z are lower-cased, which changes nothing in a text without them or a null one. Cases are as in ``manifest``.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))
    text = F.when(hit, F.translate(F.col("text"), UPPER, LOWER)).otherwise(F.col("text"))
    found = leaf_digest([text if f == "text" else F.col(f) for f in FIELDS])
    m = manifest(docs, carry={"found": F.when(hit, found)})  # untampered: the leaf as it is
    folded = fold(F.coalesce("found", "leaf"), F.col("steps"))
    return (m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
