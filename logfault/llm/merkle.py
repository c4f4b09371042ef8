"""Merkle manifest of a dataset by nested intervals.

The rows of each group are leaves, ranked by their order. A node of the tree
carries the interval ``[lo, hi)`` of the leaf ranks that it covers, so its
place says everything about its relatives: an ancestor is the one node of a
level whose interval contains the leaf's rank, and a leaf's siblings are what
remains of the parent's interval without the own one. Three consecutive nodes
become one, the last run of a level may be shorter. The roots of the groups
are the leaves of one more tree over all groups.

Levels are built and looked up in bands of ``BAND``. A band's nodes that share
an ancestor at the top of the band form a bucket of at most ``3 ** BAND``
nodes: the row of one group-by, whatever the size of a group. On the way down
each bucket meets the one node above it by an equi-join on (group, bucket) that
checks containment, and hands the path on, so no key of a join is hot and no
level is a job of its own. It is all SQL functions; only ids and digests move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import let

#: Nodes that become one node of the next level.
FAN = 3
#: Levels that are built and looked up at once.
BAND = 6
SPAN = FAN ** BAND
_AT = (1 << 33) - 1


def field(name: str) -> Column:
    """A value as the digest reads it: ``-`` for null, else its size in bytes, a colon and the value."""
    text = F.col(f"`{name}`").cast("string")
    return marked(text)


def marked(text: Column) -> Column:
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to along a path of siblings."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof(path: Column) -> Column:
    """A digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _same(name: str, other: str) -> Column:
    return F.col(name).eqNullSafe(F.col(other))


def ranked(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` (with ``grp``) with the ``rank`` from 0 of each row in its group and the ``n`` of the group.

    Rows are range-partitioned by group and order and written once. A row's
    rank is its place in the partition plus the rows of its group in earlier
    partitions; a hot group is many partitions.
    """
    keys = [F.col("grp").asc_nulls_first(), *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "ranked").withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("grp", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("grp").orderBy("_part")
    runs = runs.select(F.col("grp").alias("_grp"), F.col("_part").alias("_run"), "_first",
                       (F.sum("_n").over(whole) - F.col("_n")).alias("_start"),
                       F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    joined = placed.join(runs, _same("grp", "_grp") & (F.col("_part") == F.col("_run")))
    return joined.withColumn("rank", F.col("_start") + F.col("_at") - F.col("_first")).drop(
        "_at", "_part", "_grp", "_run", "_first", "_start")


def _parents(nodes: Column) -> Column:
    """The next level: runs of ``FAN`` nodes, their joint intervals and the digest of their digests."""
    def join(run: Column) -> Column:
        return F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"),
                        F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest"))
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(FAN))
    return F.transform(starts, lambda s: let(F.slice(nodes, s, FAN), join))


def _buckets(entries: DataFrame, band: int) -> DataFrame:
    """One row per bucket of a band: its entries and the levels above them, ``l0`` to ``l<BAND>``.

    ``entries`` has ``grp, n, rank, digest, payload``; ``rank`` counts the
    nodes of the band's lowest level. ``steps`` is the number of levels until
    the bucket, or the whole group, is one node: ``top``.
    """
    width = FAN ** (BAND * band)
    rows = entries.select("grp", "n", F.struct("rank", (F.col("rank") * width).alias("lo"), F.least(
        (F.col("rank") + 1) * width, F.col("n")).alias("hi"), "digest", "payload").alias("e"))
    rows = rows.groupBy("grp", F.expr(f"e.rank div {SPAN}").alias("bucket")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list("e")).alias("entries"))
    left = F.ceil(F.col("n") / F.lit(width))
    steps = sum(((left > FAN ** s).cast("int") for s in range(BAND)), F.lit(0))
    rows = rows.withColumn("steps", steps).withColumn("l0", F.transform("entries", lambda e: F.struct(
        e["lo"].alias("lo"), e["hi"].alias("hi"), e["digest"].alias("digest"))))
    for k in range(1, BAND + 1):
        rows = rows.withColumn(f"l{k}", F.when(F.col("steps") >= k, _parents(F.col(f"l{k - 1}"))))
    top = F.coalesce(*(F.col(f"l{k}") for k in range(BAND, -1, -1)))[0]
    return materialise(rows.withColumn("top", top), f"band{band}")


def _path(entry: Column) -> Column:
    """An entry's siblings, level by level within its bucket: the parent's run without the interval of the entry."""
    at = F.pmod(entry["rank"], F.lit(SPAN))

    def step(k: int) -> Column:
        run = F.slice(F.col(f"l{k}"), (F.floor(at / FAN ** (k + 1)) * FAN + 1).cast("int"), FAN)
        digests = lambda xs: F.array_join(F.transform(xs, lambda x: x["digest"]), "")
        return F.when(F.col("steps") > k, let(run, lambda nodes: F.struct(
            digests(F.filter(nodes, lambda x: x["hi"] <= entry["lo"])).alias("left"),
            digests(F.filter(nodes, lambda x: x["lo"] >= entry["hi"])).alias("right"))))
    return F.array_compact(F.array(*(step(k) for k in range(BAND))))


class Tree:
    """The buckets of all bands over leaves that come from :func:`ranked` with ``digest`` and ``payload``."""

    def __init__(self, leaves: DataFrame) -> None:
        most = leaves.agg(F.max("n")).first()[0] or 0
        self.bands: list[DataFrame] = []
        entries = leaves.select("grp", "n", "rank", "digest", "payload")
        while True:
            self.bands.append(_buckets(entries, len(self.bands)))
            if SPAN ** len(self.bands) >= most:
                break
            entries = self.bands[-1].select("grp", "n", F.col("bucket").alias("rank"), F.col("top.digest").alias("digest"),
                                            F.lit(None).cast("string").alias("payload"))

    def roots(self) -> DataFrame:
        """``grp, n, digest``: one row per group."""
        return self.bands[-1].select("grp", "n", F.col("top.digest").alias("digest"))

    def nodes(self) -> DataFrame:
        """All nodes: ``grp, level, lo, hi, digest``; leaves have level 0."""
        out = None
        for band, rows in enumerate(self.bands):
            for k in range(0 if band == 0 else 1, BAND + 1):
                level = rows.select("grp", F.lit(band * BAND + k).alias("level"), F.inline(f"l{k}"))
                out = level if out is None else out.unionByName(level)
        return out

    def leaves(self, above: DataFrame | None = None) -> DataFrame:
        """``grp, rank, digest, payload, path`` of every leaf, and ``above`` of its group.

        ``path`` has the siblings ``left`` and ``right`` per level, as joined
        digests. ``above`` has ``grp``, ``path`` and more columns; its path is
        added behind. Going down, a bucket meets the node that contains it.
        """
        top = self.bands[-1]
        if above is None:
            none = F.array().cast("array<struct<left:string,right:string>>")
            up = top.withColumn("above", F.struct(none.alias("path")))
        else:
            renamed = above.select(F.col("grp").alias("_grp"), F.struct(*(c for c in above.columns if c != "grp")).alias("above"))
            up = top.join(renamed, _same("grp", "_grp")).drop("_grp")
        for rows in [*self.bands[-2::-1], None]:
            found = up.select("grp", "above", F.explode(F.transform("entries", lambda e: F.struct(
                e["rank"].alias("rank"), e["lo"].alias("lo"), e["hi"].alias("hi"), e["digest"].alias("digest"),
                e["payload"].alias("payload"), _path(e).alias("path")))).alias("e"))
            found = found.select("grp", "e.*", F.col("above").withField("path", F.concat("e.path", "above.path")).alias("_above"))
            if rows is None:
                return found.select("grp", "rank", "digest", "payload", "_above.*")
            parents = found.select(F.col("grp").alias("_grp"), F.col("rank").alias("_bucket"), F.col("lo").alias("_lo"),
                                   F.col("hi").alias("_hi"), F.col("_above").alias("above"))
            contained = (F.col("top.lo") >= F.col("_lo")) & (F.col("top.hi") <= F.col("_hi"))
            up = rows.join(parents, _same("grp", "_grp") & (F.col("bucket") == F.col("_bucket")) & contained).drop(
                "_grp", "_bucket", "_lo", "_hi")


def manifest(df: DataFrame, fields: Sequence[str], group: str = "source", id_col: str = "doc_id",
             payload: dict[str, Column] | None = None) -> DataFrame:
    """A leaf per row of ``df``: its id, group, ``rank``, ``leaf``, ``subroot``, ``root``, ``path`` and ``payload``.

    A leaf is the digest of ``fields``. Leaves of a group ascend by id, a null
    id comes first; rows with one id follow their digests, so repeated rows
    are leaves of their own with equal digests. Groups ascend bytewise, null
    first. An empty table gives no rows. ``payload`` adds expressions over
    ``df`` to the row; other columns are not read, and none is overwritten.
    """
    extra = payload or {}
    rows = df.select(F.col(f"`{group}`").alias("grp"), digest(*(field(f) for f in fields)).alias("digest"),
                     F.struct(F.col(f"`{id_col}`").alias("id"), *(e.alias(n) for n, e in extra.items())).alias("payload"))
    tree = Tree(ranked(rows, [F.col("payload.id").asc_nulls_first(), F.col("digest").asc(), *(
        F.col(f"payload.{n}").asc() for n in extra)]))
    subroots = tree.roots().select(F.lit(0).alias("grp"), "digest", F.col("grp").alias("payload"))
    top = Tree(ranked(subroots, [F.col("payload").asc_nulls_first()]))
    root = top.roots().select(F.col("digest").alias("root"))
    # One row: the root of all.
    above = top.leaves().select(F.col("payload").alias("grp"), "path", F.col("digest").alias("subroot")).crossJoin(root)
    found = tree.leaves(above)
    return found.select(F.col("payload.id").alias(id_col), F.col("grp").alias(group), "rank", F.col("digest").alias("leaf"),
                        "subroot", "root", "path", *(F.col(f"payload.{n}").alias(n) for n in extra))


def verified(rows: DataFrame, leaf: str) -> DataFrame:
    """Adds ``proof_sha256``, ``folded_root`` from the column ``leaf`` and the path, and ``verified``."""
    rows = rows.withColumns({"proof_sha256": proof(F.col("path")), "folded_root": fold(F.col(leaf), F.col("path"))})
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
