"""Log template mining and matching.

Messages are masked and collapsed to distinct ones first, which removes most
of the volume. Distinct messages are routed by token count and leading
tokens. Clustering inside a route is order-dependent: a route is a stream of
its messages by first row, and a message may change the templates that later
ones meet.

Most messages change nothing, so a busy route is mined in rounds. Only chosen
messages go through the stream, which notes each version of a template with
the messages that began and ended it. All others are then compared, in slices
and in parallel, with the versions that were alive when they arrived. Those
that would have changed a template are chosen as well, the earliest first,
and the next round begins; when there are none, every message has met exactly
the templates that it meets in one long stream, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.cleaning import WILDCARD, mask, words
from ..sources.scratch import materialise
from .lookup import counted_broadcast, lookup
from .ranking import last_per_group, sliced_rank

SIMILARITY = 0.4
EXTRA_DELIMITERS = "_"
MAX_SHAPES = 10_000
PREFIX_DEPTH = 1
#: Messages of a route that the first round chooses; routes with no more are one stream.
FIRST_ROWS = 4_096
#: Messages of a busy route that one task compares with its templates, about.
SLICE_ROWS = 50_000
#: Each round may choose so many times more messages per slice than the one before.
GROWTH = 4
#: Comparisons of tokens that are held at once.
CELLS = 4_000_000

_VERSIONS = ("route string, cluster int, codes array<bigint>, template array<string>, size bigint, first_row bigint, "
             "known_id bigint, born_row bigint, born array<string>, died_row bigint, died array<string>")
_JUDGED = "route string, tokens array<string>, codes array<bigint>, size bigint, first_row bigint, cluster int"
_TEXTS, _LONGS = pa.list_(pa.string()), pa.list_(pa.int64())


def template_tokens(text, delimiters: str = EXTRA_DELIMITERS):
    text = F.col(text) if isinstance(text, str) else text
    return words(F.translate(text, delimiters, " " * len(delimiters)))


def masked_messages(logs: DataFrame, msg: str = "msg_lower") -> DataFrame:
    """Distinct messages with their masked tokens, count and first row."""
    return (logs.groupBy(msg).agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_row"))
            .withColumn("tokens", template_tokens(mask(msg))))


def _route(tokens, depth: int):
    """Token count and the leading ``depth`` tokens; a token with a digit is a wildcard."""
    head = F.transform(F.slice(tokens, 1, depth),
                       lambda t: F.when(t.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(t))
    return F.concat_ws(" ", F.size(tokens).cast("string"), F.array_join(head, " "))


class _Route:
    """The templates of one route, grown message by message.

    A known template starts its own cluster. A message joins the cluster with
    the most equal tokens if that share reaches the limit (ties: more
    wildcards, then the older cluster); differing positions become wildcards.
    Tokens are compared by their hash, 0 is the wildcard.
    """

    def __init__(self, name: str, length: int, similarity: float) -> None:
        self.name, self.least = name, similarity * length
        self.codes = np.empty((8, length), np.int64)
        self.tokens: list[list[str]] = []
        self.sizes: list[int] = []
        self.firsts: list[int] = []
        self.known: list[int | None] = []
        self.born: list[tuple[int | None, list[str]]] = []
        self.past: list[tuple] = []  # versions that have ended

    def add(self, tokens: list[str], codes: np.ndarray, size: int, first: int, known: int | None) -> None:
        count = len(self.tokens)
        if count and known is None:
            live = self.codes[:count]
            equal = ((live == codes) & (live != 0)).sum(axis=1)
            top = equal.max()
            if top >= self.least:
                ties = np.flatnonzero(equal == top)
                best = ties[np.argmax((live[ties] == 0).sum(axis=1))]
                differ = np.flatnonzero((live[best] != codes) & (live[best] != 0))
                if len(differ):
                    self.past.append(self._version(best, (first, tokens)))
                    self.tokens[best] = list(self.tokens[best])
                    self.born[best] = (first, tokens)
                    live[best][differ] = 0
                    for i in differ.tolist():
                        self.tokens[best][i] = WILDCARD
                self.sizes[best] += size
                self.firsts[best] = min(self.firsts[best], first)
                return
        if count == len(self.codes):
            self.codes = np.concatenate([self.codes, np.empty_like(self.codes)])
        self.codes[count] = codes
        self.tokens.append(list(tokens))
        self.sizes.append(size)
        self.firsts.append(first)
        self.known.append(known)
        self.born.append((first if known is None else None, tokens))

    def _version(self, i: int, died: tuple) -> tuple:
        return (self.name, int(i), self.codes[i].tolist(), self.tokens[i], self.sizes[i], self.firsts[i], self.known[i],
                *self.born[i], *died)

    def rows(self) -> pa.RecordBatch:
        """All versions; those of today have no ``died_row``."""
        every = self.past + [self._version(i, (None, None)) for i in range(len(self.tokens))]
        kinds = [pa.string(), pa.int32(), _LONGS, _TEXTS, pa.int64(), pa.int64(), pa.int64(), pa.int64(), _TEXTS, pa.int64(), _TEXTS]
        names = [c.split()[0] for c in _VERSIONS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*every), kinds)], names=names)


def _cluster_stream(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, route = None, None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("route", "tokens", "codes", "size", "first_row", "known_id")]
            for name, tokens, codes, size, first, known in zip(*columns):
                if name != current:
                    if route is not None:
                        yield route.rows()
                    current, route = name, _Route(name, len(tokens), similarity)
                route.add(tokens, np.array(codes, np.int64), size, first, known)
        if route is not None:
            yield route.rows()
    return run


class _Frozen:
    """The versions of one route's templates, to compare many messages with."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.rows = similarity, []

    def ready(self) -> None:
        self.rows.sort(key=lambda r: r["cluster"])
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        self.codes = np.array([r["codes"] for r in self.rows], np.int64).reshape(len(self.rows), -1)
        self.clusters = np.array([r["cluster"] for r in self.rows])
        self.born = np.array([low if r["born_row"] is None else r["born_row"] for r in self.rows], np.int64)
        self.died = np.array([high if r["died_row"] is None else r["died_row"] for r in self.rows], np.int64)
        self.fixed = (self.codes != 0).sum(axis=1)

    def _alive(self, rows: np.ndarray, tokens: list[list[str]]) -> np.ndarray:
        """Versions that began before a message and ended after it; equal rows are ordered by their tokens."""
        at = rows[:, None]
        alive = (self.born < at) & (at < self.died)
        for i, v in np.argwhere((self.born == at) | (self.died == at)).tolist():
            row = self.rows[v]
            began = self.born[v] < rows[i] or (self.born[v] == rows[i] and row["born"] < tokens[i])
            ended = self.died[v] < rows[i] or (self.died[v] == rows[i] and row["died"] < tokens[i])
            alive[i, v] = began and not ended
        return alive

    def judge(self, codes: np.ndarray, rows: np.ndarray, tokens: list[list[str]]) -> np.ndarray:
        """The cluster that each message joins without changing it, -1 if there is none."""
        out = np.full(len(rows), -1)
        length = codes.shape[1]
        step = max(1, CELLS // max(1, len(self.rows) * max(1, length)))
        for a in range(0, len(rows), step):
            part = slice(a, a + step)
            equal = ((codes[part, None, :] == self.codes) & (self.codes != 0)).sum(axis=2)
            rank = np.where(self._alive(rows[part], tokens[part]), equal * (length + 1) + length - self.fixed, -1)
            best = rank.argmax(axis=1)
            top = equal[np.arange(len(best)), best]
            calm = (rank.max(axis=1) >= 0) & (top >= self.similarity * length) & (top == self.fixed[best])
            out[part] = np.where(calm, self.clusters[best], -1)
        return out


def _judge_stream(similarity: float, most: int):
    """Totals of the messages that change nothing, and the first ``most`` of each slice that change something."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), _TEXTS, _LONGS, pa.int64(), pa.int64(), pa.int32()]
        names = [c.split()[0] for c in _JUDGED.split(", ")]
        current, frozen, held, found, totals = None, None, [], [], {}

        def settle() -> None:
            nonlocal held
            if not held:
                return
            if not hasattr(frozen, "codes"):
                frozen.ready()
            if len(found) < most:
                codes = np.array([r["codes"] for r in held], np.int64).reshape(len(held), -1)
                rows, tokens = np.array([r["first_row"] for r in held], np.int64), [r["tokens"] for r in held]
                for r, cluster in zip(held, frozen.judge(codes, rows, tokens).tolist()):
                    if cluster >= 0:
                        size, first = totals.get(cluster, (0, r["first_row"]))
                        totals[cluster] = size + r["size"], min(first, r["first_row"])
                    elif len(found) < most:
                        found.append((current[0], r["tokens"], r["codes"], r["size"], r["first_row"], None))
            held = []

        def close() -> Iterator[pa.RecordBatch]:
            settle()
            out = found + [(current[0], None, None, size, first, cluster) for cluster, (size, first) in totals.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                group = row["route"], row["slice"]
                if group != current:
                    if current is not None:
                        yield from close()
                    current, frozen, held, found, totals = group, _Frozen(similarity), [], [], {}
                if row["cluster"] is not None:
                    frozen.rows.append(row)
                else:
                    held.append(row)
                    if len(held) >= 4096:
                        settle()
        if current is not None:
            yield from close()
    return run


def _merge_equal(items: DataFrame) -> DataFrame:
    return (items.groupBy("tokens")
            .agg(F.sum("size").alias("size"), F.min("first_row").alias("first_row"),
                 F.min("known_id").alias("known_id")))


def _stream(chosen: DataFrame, similarity: float) -> DataFrame:
    ordered = (chosen.repartition("route")
               .sortWithinPartitions("route", F.col("known_id").asc_nulls_last(), "first_row", "tokens")
               .select("route", "tokens", "codes", "size", "first_row", "known_id"))
    return ordered.mapInArrow(_cluster_stream(similarity), _VERSIONS)


def _busy_routes(routed: DataFrame, first_rows: int, slice_rows: int) -> DataFrame:
    """``route, slices`` of the routes with more than ``first_rows`` messages."""
    counts = routed.groupBy("route").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > first_rows)
    return counts.select("route", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))


def _in_slices(rows: DataFrame, busy: DataFrame) -> DataFrame:
    """Messages of busy routes with their ``slice``."""
    return (rows.join(busy, "route").withColumn("slice", F.pmod(F.xxhash64("tokens"), F.col("slices")).cast("int"))
            .drop("slices"))


def _judged(rest: DataFrame, versions: DataFrame, busy: DataFrame, similarity: float, most: int) -> DataFrame:
    """All messages of ``rest`` against the versions of their route, slice by slice."""
    spread = versions.join(busy, "route").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    none = {"cluster": "int", "born_row": "bigint", "born": "array<string>", "died_row": "bigint", "died": "array<string>",
            "tokens": "array<string>"}
    columns = ["route", "slice", "codes", "size", "first_row", *none]
    both = spread.withColumn("tokens", F.lit(None).cast("array<string>")).select(columns).unionByName(
        rest.withColumns({c: F.lit(None).cast(k) for c, k in none.items() if c != "tokens"}).select(columns))
    dealt = both.repartition("route", "slice").sortWithinPartitions(
        "route", "slice", F.col("cluster").asc_nulls_last(), "first_row", "tokens")
    return dealt.mapInArrow(_judge_stream(similarity, most), _JUDGED)


def _mine_in_rounds(routed: DataFrame, busy: DataFrame, similarity: float, first_rows: int) -> DataFrame:
    """The versions of all templates, with what the messages outside the stream add to their sizes."""
    message = F.col("known_id").isNull()
    lazy = routed.join(busy, "route", "left_anti")
    hot = _in_slices(routed, busy)
    first = last_per_group(hot.filter(message), ["route"], [F.col("first_row"), F.col("tokens")], first_rows).drop("age_rank")
    chosen = materialise(first.unionByName(hot.filter(~message)).drop("slice"), "chosen")
    most = first_rows
    while True:
        versions = materialise(_stream(lazy.unionByName(chosen), similarity), "versions")
        rest = hot.filter(message).join(chosen.filter(message).select("tokens"), "tokens", "left_anti")
        judged = materialise(_judged(rest, versions, busy, similarity, most), "judged")
        more = judged.filter(F.col("cluster").isNull())
        if not more.take(1):
            break
        more = more.select("route", "tokens", "codes", "size", "first_row", F.lit(None).cast("bigint").alias("known_id"))
        chosen = materialise(chosen.unionByName(more), "chosen")
        most *= GROWTH
    calm = judged.groupBy("route", "cluster").agg(F.sum("size").alias("_more"), F.min("first_row").alias("_earlier"))
    return (versions.filter("died_row IS NULL").join(calm, ["route", "cluster"], "left")
            .withColumn("size", F.col("size") + F.coalesce("_more", F.lit(0)))
            .withColumn("first_row", F.least("first_row", "_earlier")))


def mine_templates(logs: DataFrame, msg: str = "msg_lower", known: DataFrame | None = None,
                   similarity: float = SIMILARITY, prefix_depth: int = PREFIX_DEPTH,
                   max_clusters: int | None = None, first_rows: int = FIRST_ROWS,
                   slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Template dictionary of a log.

    Columns ``template_id`` (by first row, from 1), ``template``, ``tokens``,
    ``n_tokens``, ``first_token``, ``size``, ``first_row``. ``known`` is an
    earlier dictionary: its templates keep their ids and go on growing.
    Messages are compared with templates of equal length that share their
    leading ``prefix_depth`` tokens; a larger depth gives more, narrower
    routes. ``max_clusters`` keeps only the largest templates. ``first_rows``
    and ``slice_rows`` divide the work and never change the result.
    """
    items = (masked_messages(logs, msg).groupBy("tokens")
             .agg(F.sum("n_rows").alias("size"), F.min("first_row").alias("first_row"))
             .withColumn("known_id", F.lit(None).cast("bigint")))
    if known is not None:
        items = items.unionByName(known.select("tokens", "size", "first_row", F.col("template_id").alias("known_id")))
    codes = F.transform("tokens", lambda t: F.when(t == WILDCARD, F.lit(0).cast("bigint")).otherwise(F.xxhash64(t)))
    routed = materialise(items.select(_route(F.col("tokens"), prefix_depth).alias("route"), "tokens", codes.alias("codes"),
                                      "size", "first_row", "known_id"), "routed")
    # At most one row per ``first_rows`` messages.
    busy = materialise(_busy_routes(routed, first_rows, slice_rows), "busy")
    if busy.take(1):
        found = _mine_in_rounds(routed, counted_broadcast(busy), similarity, first_rows)
    else:
        found = _stream(routed, similarity).filter("died_row IS NULL")
    mined = _merge_equal(found.select(F.col("template").alias("tokens"), "size", "first_row", "known_id"))
    if max_clusters is not None:
        mined = mined.orderBy(F.col("size").desc(), "first_row").limit(max_clusters)
    return _number(materialise(mined, "templates"), known)


def _number(mined: DataFrame, known: DataFrame | None) -> DataFrame:
    start = 0
    if known is not None:
        start = known.agg(F.coalesce(F.max("template_id"), F.lit(0))).first()[0]
    fresh = sliced_rank(mined.filter(F.col("known_id").isNull()), [],
                        {"_block": F.shiftright("first_row", 20)},
                        [F.col("first_row"), F.array_join("tokens", " ")], "template_id")
    fresh = fresh.withColumn("template_id", F.col("template_id") + start)
    kept = mined.filter(F.col("known_id").isNotNull()).withColumn("template_id", F.col("known_id"))
    return (fresh.unionByName(kept.select(*fresh.columns))
            .select(F.col("template_id").cast("bigint").alias("template_id"),
                    F.array_join("tokens", " ").alias("template"), "tokens",
                    F.size("tokens").alias("n_tokens"),
                    F.coalesce(F.get("tokens", F.lit(0)), F.lit("")).alias("first_token"),
                    "size", "first_row"))


def save_templates(templates: DataFrame, path: str) -> None:
    templates.write.mode("overwrite").parquet(path)


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def match_templates(messages: DataFrame, templates: DataFrame, key: str = "msg_lower") -> DataFrame:
    """The template of each distinct message (``key``, ``tokens``).

    A template matches when every position that is no wildcard is equal. The
    wildcard positions of the templates form few distinct shapes; a message
    is blanked at each shape of its length and then looked up by equality.
    Several matches: fewest wildcards, then the lowest id.
    """
    blank = F.filter(F.transform("tokens", lambda t, i: F.when(t == WILDCARD, i)), lambda i: i.isNotNull())
    first = F.coalesce(F.get("tokens", F.lit(0)), F.lit(""))
    patterns = templates.select(F.array_join("tokens", " ").alias("pattern"), F.col("n_tokens").alias("_n"),
                                first.alias("_first"), blank.alias("wild"), "template_id", "template")
    shapes = patterns.select("_n", "_first", "wild").distinct()
    if not shapes.limit(MAX_SHAPES + 1).offset(MAX_SHAPES).take(1):
        shapes = F.broadcast(shapes)
    # A template starts with the message's first token or with a wildcard.
    asked = messages.select(key, "tokens", F.size("tokens").alias("_n"),
                            F.explode(F.array_distinct(F.array(first, F.lit(WILDCARD)))).alias("_first"))
    asked = asked.join(shapes, ["_n", "_first"])
    asked = asked.select(key, "_n", F.array_join(F.transform("tokens", lambda t, i: F.when(
        F.array_contains("wild", i), F.lit(WILDCARD)).otherwise(t)), " ").alias("pattern"))
    found = asked.join(patterns, ["_n", "pattern"])
    best = F.min(F.struct(F.size("wild").alias("w"), "template_id", "template")).alias("b")
    return found.groupBy(key).agg(best).select(key, "b.template_id", "b.template")


def attach_templates(logs: DataFrame, templates: DataFrame, msg: str = "msg_lower") -> DataFrame:
    """Add ``template_id`` and ``template`` to every log row, ``'None'`` where
    no template matches."""
    messages = masked_messages(logs, msg)
    matched = (messages.select(msg, "n_rows")
               .join(match_templates(messages, templates, msg), msg)
               .withColumn("template_id", F.col("template_id").cast("string")))
    found = lookup(logs, matched, msg, ["template_id", "template"], weight="n_rows")
    return found.fillna("None", ["template_id", "template"])
