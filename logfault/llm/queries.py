"""The queries of the text operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encoded
from .common import table
from .lexical import ranked_search
from .merkle import digest, field, manifest, marked, verified
from .packing import pack
from .personal_data import fit, personal_data
from .quality import judged
from .secrets import RULES, Rule, secrets, spans_string
from .simhash import hex_of, near_groups
from .suffix_dedup import remove_repeats
from .toxicity import scored
from .warc import round_trip
from .url_filter import ALLOW, BLOCK, by_rules, filtered, train
from .url_filter import Rule as UrlRule
from .winnowing import compared, digest as print_digest

#: Vocabulary files, on every machine of the cluster.
ID_VOCABULARY, RANK_VOCABULARY = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


ORACLE["op1_warc"] = """
WITH d AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                  sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, payload_bytes >= 1000 AND page_id < max(page_id) OVER (PARTITION BY payload_digest) AS again,
             max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN latest END AS refers_to FROM g"""


@query
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "pages"))


@query
def op2_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = compared(table(spark, folder, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", print_digest(F.col("print")).alias("fingerprint"),
                        print_digest(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = personal_data(docs, fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"), vocabulary(RANK_VOCABULARY), keep_ids=False).drop("ids")


def _spans_sql(rank: int, rule: Rule) -> str:
    """A row per match: its place from the lengths of the gaps and matches before it."""
    p = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""
SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, before AS s, before + length(found[i]) AS e FROM (
  SELECT doc_id, i, found, measured, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS before FROM (
    SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS found,
           regexp_extract_all(text, {p}, {rule.group}) AS measured, unnest(range(1, len(regexp_extract_all(text, {p})) + 1)) AS i
    FROM documents)) WHERE length(measured[i]) >= {rule.least}"""


ORACLE["op5_secrets"] = f"""
WITH spans AS ({" UNION ALL ".join(_spans_sql(i, r) for i, r in enumerate(RULES))}),
texts AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans,
          {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES)} FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)},
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN texts USING (doc_id)"""


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = secrets(table(spark, folder, "documents"))
    text = spans_string(F.col("spans"))
    counts = [_count("spans", r.kind) for r in RULES]
    return found.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"),
                        text.alias("spans"))


@query
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), vocabulary(ID_VOCABULARY))


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents"))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


# Every window of 400 bytes by its hash, then the runs that repeated ones cover.
ORACLE["op9_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
pieces AS (SELECT doc_id, j, least(500, n - 399 - j) AS m, substr(x, 2 * j + 1, 1798) AS y
           FROM (SELECT *, unnest(range(0, n - 399, 500)) AS j FROM n WHERE n >= 400)),
w AS (SELECT doc_id, j + o AS i, md5(substr(y, 2 * o + 1, 800)) AS g FROM (SELECT *, unnest(range(0, m)) AS o FROM pieces)),
twice AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w SEMI JOIN twice USING (g)),
r AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
parts AS (SELECT doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last,
                 CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans FROM k JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN parts USING (doc_id)"""


@query
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), keep_first=False).drop("kept")


@query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", hex_of("point").alias("fingerprint"), "component_id")


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# Levels by recursion; a leaf is folded along the runs of its ancestors. The checksum of an id is made bit by bit.
ORACLE["op11_merkle"] = """
WITH RECURSIVE f AS (SELECT doc_id, source, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
    lambda v: CASE WHEN v IS NULL THEN '-' ELSE octet_length(encode(v)) || ':' || v END) AS parts, text, replace(text, chr(10), '') AS cut,
  list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce(
    range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, b)), 4294967295) AS crc FROM documents),
v AS (SELECT doc_id, source, array_to_string(parts, '') AS head, text, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN cut ELSE text END AS cut FROM f),
h AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END) AS leaf,
  sha256(head || CASE WHEN cut IS NULL THEN '-' ELSE octet_length(encode(cut)) || ':' || cut END) AS seen FROM v),
g AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) AS g FROM (SELECT DISTINCT source FROM documents)),
l AS (SELECT h.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i FROM h JOIN g ON g.source IS NOT DISTINCT FROM h.source),
n(k, g, i, d, many) AS (SELECT 0, g, i, leaf, count(*) OVER (PARTITION BY g) FROM l UNION ALL
  SELECT k, g, i, d, count(*) OVER (PARTITION BY g) FROM (
    SELECT k + 1 AS k, g, i // 3 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM n WHERE many > 1 GROUP BY k + 1, g, i // 3)),
t(k, i, d, many) AS (SELECT 0, g - 1, d, count(*) OVER () FROM n WHERE many = 1 UNION ALL
  SELECT k, i, d, count(*) OVER () FROM (
    SELECT k + 1 AS k, i // 3 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM t WHERE many > 1 GROUP BY k + 1, i // 3)),
e AS (SELECT 0 AS part, k, g, i, d FROM n WHERE many > 1 UNION ALL SELECT 1, k, 0, i, d FROM t WHERE many > 1),
hs AS (SELECT g, max(k) AS h FROM n GROUP BY g),
s(doc_id, g, own, part, k, i, d, sib) AS (
  SELECT doc_id, l.g, l.g, CASE WHEN h = 0 THEN 1 ELSE 0 END, 0, CASE WHEN h = 0 THEN l.g - 1 ELSE i END, seen, '' FROM l JOIN hs USING (g)
  UNION ALL
  SELECT doc_id, own, own, CASE WHEN part = 0 AND k + 1 = h THEN 1 ELSE part END, CASE WHEN part = 0 AND k + 1 = h THEN 0 ELSE k + 1 END,
         CASE WHEN part = 0 AND k + 1 = h THEN own - 1 ELSE i // 3 END, d, sib FROM (
    SELECT doc_id, own, s.part, s.k, s.i, sha256(string_agg(CASE WHEN e.i = s.i THEN s.d ELSE e.d END, '' ORDER BY e.i)) AS d,
           any_value(sib) || coalesce(string_agg(e.d, '' ORDER BY e.i) FILTER (WHERE e.i <> s.i), '') AS sib
    FROM s JOIN e ON e.part = s.part AND e.k = s.k AND e.i // 3 = s.i // 3 AND (s.part = 1 OR e.g = s.own)
    GROUP BY doc_id, own, s.part, s.k, s.i) JOIN hs ON hs.g = own),
top AS (SELECT max(k) AS h, max_by(d, k) AS root FROM t)
SELECT l.doc_id, leaf, n.d AS subroot, root, sha256(s.sib) AS proof_sha256, s.d AS folded_root, s.d = root AS verified
FROM l JOIN n ON n.g = l.g AND n.many = 1 CROSS JOIN top JOIN s ON s.doc_id = l.doc_id AND s.part = 1 AND s.k = top.h"""


@query
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = digest(*(field(c) for c in LEAF_FIELDS[:-1]), marked(F.replace("text", F.lit("\n"), F.lit(""))))
    rows = manifest(docs, LEAF_FIELDS, payload={"seen": F.when(even, cut)})
    checked = verified(rows.withColumn("seen", F.coalesce("seen", "leaf")), "seen")
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


ORACLE["op12_ball_tree"] = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM w WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w)
       SEMI JOIN q USING (term) GROUP BY doc_id, n, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * df + 1))) AS BIGINT) AS weight
           FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
score AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * tf.n * s.n) // s.l)))) AS BIGINT) AS score
          FROM q JOIN tf USING (term) JOIN weight USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 50"""


@query
def op12_ball_tree(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


URL_RULES = (UrlRule(ALLOW, "com", "/"), UrlRule(BLOCK, "example.com", "/en/"), UrlRule(ALLOW, "www.example.com", "/en/"),
             UrlRule(BLOCK, "net", "/es/"), UrlRule(BLOCK, "net", "/fr/"))


@query
def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled table is what the rules decide, so the model carries their judgement to other hosts."""
    pages = table(spark, folder, "pages")
    return filtered(pages, train(by_rules(pages, URL_RULES)), URL_RULES).drop("score")
