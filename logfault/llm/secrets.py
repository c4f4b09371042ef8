"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. The
ledger holds one row per blob and scan with the versions of the rules that
were applied and what they found, so a scan reads only blobs that lack an
entry for a rule version: new content, or all content for a new rule. Findings
are then joined back to all paths that ever held the blob. Everything is built
from SQL functions.

Rules find leftmost non-overlapping matches, the longest at each place; places
are code points. A match whose measured group is too short is dropped without
another try.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import let, text_of


@dataclass(frozen=True)
class Rule:
    """A pattern, the group that is measured and the length it must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


#: Runs of fixed least length are asked for in the pattern: as runs are taken whole, that drops the same matches.
RULES = (
    Rule("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
_ENTRY = "struct<kind:string,version:string,spans:array<struct<start:bigint,end:bigint>>>"


def running_sums(values: Column, block: int = 512) -> Column:
    """Sums of all beginnings of an array of bigint, in blocks, so long arrays cost little more than their length."""
    zero = F.array(F.lit(0).cast("bigint"))
    grow = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))

    def sums(x: Column) -> Column:
        return let(F.aggregate(x, zero, grow), lambda a: F.slice(a, 2, F.size(x)))

    def put_together(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, zero, lambda acc, b: grow(acc, F.element_at(b, -1)))
        return F.flatten(F.zip_with(blocks, F.slice(offsets, 1, F.size(blocks)),
                                    lambda b, o: F.transform(b, lambda v: v + o)))

    def cut(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(block))
        blocks = F.transform(starts, lambda i: sums(F.slice(x, i, block)))
        return F.when(F.size(x) == 0, x).otherwise(let(blocks, put_together))
    return let(values, cut)


def find(text: Column, rule: Rule) -> Column:
    """``array<struct<start, end>>`` of a rule's matches in a text, ascending."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    long = lambda a: F.transform(a, lambda s: F.char_length(s).cast("bigint"))
    sizes = long(F.regexp_extract_all(text, pattern, F.lit(0)))
    gaps = long(F.split(text, rule.pattern, -1))
    # Start of match i: the gaps up to it and the matches before it.
    ends = let(sizes, lambda m: running_sums(F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda a, b: a + b)))
    places = F.zip_with(ends, sizes, lambda e, m: F.struct((e - m).alias("start"), e.alias("end")))
    if rule.group:
        measured = long(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
        places = F.transform(F.filter(F.zip_with(places, measured, lambda p, m: F.struct(p.alias("p"), m.alias("m"))),
                                      lambda x: x["m"] >= rule.least), lambda x: x["p"])
    # Most texts have no match: one search settles them.
    return F.when(text.rlike(rule.pattern), places).otherwise(none)


def scan(history: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of ``history`` that ``ledger`` lacks.

    ``history`` has ``blob`` and ``text``; the result ``blob`` and
    ``entries`` (kind, version, spans), without blobs that are fully known.
    """
    blobs = history.groupBy("blob").agg(F.first("text").alias("text"))
    known = F.array().cast("array<string>")
    if ledger is not None:
        seen = (ledger.select("blob", F.explode("entries.version").alias("version"))
                .groupBy("blob").agg(F.collect_set("version").alias("known")))
        blobs = blobs.join(seen, "blob", "left")
        known = F.coalesce("known", known)
    entries = F.array_compact(F.array(*(
        F.when(~F.array_contains(known, r.version), F.struct(
            F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), find(F.col("text"), r).alias("spans")))
        for r in rules)))
    new = blobs.filter(F.size(F.array_except(F.array(*(F.lit(r.version) for r in rules)), known)) > 0)
    return new.select("blob", entries.cast(f"array<{_ENTRY}>").alias("entries"))


def findings(history: DataFrame, rules: Sequence[Rule] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(found, added)``: blobs with findings of the given rules, and the new ledger rows.

    ``found`` has one row per blob with at least one span: ``blob`` and
    ``spans`` (kind, start, end) by start, then in the order of the rules.
    """
    added = materialise(scan(history, rules, ledger), "ledger")
    every = added
    if ledger is not None:
        every = (ledger.select("blob", "entries").unionByName(added).groupBy("blob")
                 .agg(F.flatten(F.collect_list("entries")).alias("entries")))
    rank = F.map_from_arrays(F.array(*(F.lit(r.version) for r in rules)), F.array(*(F.lit(i) for i in range(len(rules)))))
    spans = F.flatten(F.transform(
        F.filter("entries", lambda e: F.array_contains(F.array(*(F.lit(r.version) for r in rules)), e["version"])),
        lambda e: F.transform(e["spans"], lambda s: F.struct(
            s["start"].alias("start"), rank[e["version"]].alias("rank"), s["end"].alias("end"), e["kind"].alias("kind")))))
    found = every.filter(F.exists("entries", lambda e: F.size(e["spans"]) > 0)).select(
        "blob", F.transform(F.sort_array(spans), lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    return found.filter(F.size("spans") > 0), added


def blob_of(text_col: str) -> Column:
    return F.unhex(F.sha2(text_of(text_col), 256))


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES,
            ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, spans)`` for every row of ``df``, and the new ledger rows.

    Null texts count as empty and have no spans; rows with a null id and
    repeated rows get theirs like any other. Columns other than id and text
    are not read.
    """
    found, added = findings(df.select(blob_of(text_col).alias("blob"), text_of(text_col).alias("text")), rules, ledger)
    paths = df.select(F.col(id_col).alias("doc_id"), blob_of(text_col).alias("blob"))
    joined = paths.join(found, "blob", "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return joined.select("doc_id", F.coalesce("spans", none).alias("spans")), added


def spans_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _redact_one(rule: Rule, mark: str):
    def one(t: Column) -> Column:
        pattern = F.lit(rule.pattern)
        found = F.regexp_extract_all(t, pattern, F.lit(0))
        measured = F.regexp_extract_all(t, pattern, F.lit(rule.group))
        put = F.zip_with(found, measured, lambda f, m: F.when(F.char_length(m) >= rule.least, F.lit(mark)).otherwise(f))
        parts = F.zip_with(F.split(t, rule.pattern, -1), put, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(t.rlike(rule.pattern), F.array_join(parts, "")).otherwise(t)
    return one


def redact(text: Column, rules: Sequence[Rule] = RULES, mark: str = "[REDACTED]") -> Column:
    """The text with each rule's matches replaced, one rule after the other."""
    for rule in rules:
        text = let(text, _redact_one(rule, mark))
    return text


def without_secrets(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars",
                    rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with secrets replaced by a mark; rows and columns stay, ``chars_col`` is set anew in changed rows.

    A null text stays null, an empty one empty; repeated rows are redacted
    alike, an empty table stays empty. Columns may have any names.
    """
    found, _ = findings(df.select(blob_of(text_col).alias("blob"), text_of(text_col).alias("text")), rules)
    others = [c for c in df.columns if c != text_col]
    # The user's columns travel in a struct, so no name can clash.
    rest = F.struct(F.lit(True).alias("any"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    rows = df.select(blob_of(text_col).alias("blob"), F.col(f"`{text_col}`").alias("text"), rest.alias("rest"))
    joined = rows.join(found.select(F.col("blob").alias("hit")), F.col("blob") == F.col("hit"), "left")
    changed = F.col("hit").isNotNull()
    out = joined.select("rest", changed.alias("changed"), F.when(changed, redact(F.col("text"), rules)).otherwise(F.col("text")).alias("text"))
    columns = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)}
    if chars_col in columns:
        kind = df.schema[chars_col].dataType
        columns[chars_col] = F.when(F.col("changed"), F.char_length("text").cast(kind)).otherwise(columns[chars_col])
    columns[text_col] = F.col("text")
    return out.select(*(columns[c].alias(c) for c in df.columns))
