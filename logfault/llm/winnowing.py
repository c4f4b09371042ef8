"""Document fingerprints by winnowing.

Tokens are words, or single characters of scripts without blanks. Every
``gram`` neighbouring tokens give one hash; it rolls over the text by joining
the hashes of two shorter neighbours. Of each window of ``window`` hashes the
smallest is kept, the rightmost of equals, with its place. So two texts that
share ``gram + window - 1`` tokens in a row share a fingerprint, and its place
tells where. A text with fewer tokens than a gram is one gram, one with fewer
grams than a window is one window. All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, text_of

#: Tokens in a gram and grams in a window: shared runs of 8 words are always found.
GRAM, WINDOW = 3, 6
_TOKEN = "[\\u3040-\\u30FF\\u3400-\\u9FFF]|[^\\x20\\x09-\\x0D\\u3040-\\u30FF\\u3400-\\u9FFF]+"
_PLACES = (1 << 31) - 1
#: Documents in a bucket of neighbours.
BUCKET = 256
#: Cells that the range of ids is first cut into, by their number of documents.
CELLS = 200


def _step(step: int, join):
    def one(h: Column) -> Column:
        return F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), F.slice(h, step + 1, F.size(h)), join)
    return one


def _doubled(values: Column, width: int, join, whole) -> Column:
    """For each place the join of ``width`` neighbours, in about log2(width) passes; ``whole`` of fewer values."""
    def all_of(h: Column) -> Column:
        done, out = 1, h
        while done < width:
            step = min(done, width - done)
            out = let(out, _step(step, join))
            done += step
        return F.when((F.size(h) >= width) | (F.size(h) == 0), out).otherwise(F.array(whole(h)))
    return let(values, all_of)


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """``array<bigint>``: the kept hashes with their places, by place; see :func:`hash_of` and :func:`place_of`."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    hashes = _doubled(F.transform(tokens, lambda t: F.xxhash64(t)), gram,
                      lambda a, b: F.xxhash64(a, b), lambda h: F.xxhash64(h))
    # 32 bits of hash above 31 bits of place, counted down: the least is the smallest hash, the rightmost of equals.
    packed = F.transform(hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR(
        F.lit(_PLACES).cast("bigint") - i))
    return F.array_distinct(_doubled(packed, window, lambda a, b: F.least(a, b), lambda p: F.array_min(p)))


def hash_of(entry: Column) -> Column:
    return F.shiftrightunsigned(entry, 31)


def place_of(entry: Column) -> Column:
    """The number of the gram, from 0."""
    return F.lit(_PLACES) - entry.bitwiseAND(F.lit(_PLACES).cast("bigint"))


def hashes_of(print_: Column) -> Column:
    return F.array_distinct(F.transform(print_, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike."""
    def share(common: Column) -> Column:
        return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(
            F.try_divide(common.cast("double"), F.size(a) + F.size(b) - common))
    return let(F.size(F.array_intersect(a, b)), share)


def digest(print_: Column) -> Column:
    return F.sha2(F.array_join(print_.cast("array<string>"), ","), 256)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``doc_id, text, next_text``: each text with that of the next row by id, after the last the first.

    Null ids come first; rows with one id follow each other by the hash of
    their text. The range of ids is cut into cells of about equal numbers of
    rows and these into buckets of equal width, so no task sorts more than a
    bucket; the last row of a bucket meets the first of the next in a join of
    one row per bucket. Texts move only by their bucket.
    """
    key = F.col(id_col).cast("double")
    counts = df.agg(F.count("*").alias("n"), F.percentile_approx(
        key, [i / CELLS for i in range(CELLS + 1)], 10_000).alias("bounds")).first()
    bounds = sorted(set(counts.bounds or [])) or [0.0]
    per_cell = max(1, counts.n // len(bounds) // bucket)
    edges = F.array(*(F.lit(b) for b in bounds))
    widths = F.array(*(F.lit((b - a) / per_cell) for a, b in zip(bounds, bounds[1:])), F.lit(1.0))
    cell = F.coalesce(F.size(F.filter(edges, lambda b: b <= key)), F.lit(0))  # at most CELLS + 1; 0 for null
    inside = (F.col("cell") > 0) & (F.col("cell") < len(bounds))
    at = F.col("cell") - 1
    sub = F.when(inside, F.floor((key - F.get(edges, at)) / F.get(widths, at))).otherwise(F.lit(0).cast("bigint"))
    buckets = df.withColumn("cell", cell).withColumn("sub", sub).select("cell", "sub")
    placed = (df.withColumn("cell", cell).withColumn("sub", sub)
              .select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), "cell", "sub"))

    # The bucket after each bucket; between cells by a table of at most CELLS + 2 rows.
    links = buckets.distinct().withColumn("next_sub", F.lead("sub").over(Window.partitionBy("cell").orderBy("sub")))
    cells = [tuple(r) for r in buckets.groupBy("cell").agg(F.min("sub")).orderBy("cell").collect()]
    turns = [(a, *b) for (a, _), b in zip(cells, cells[1:] + cells[:1])]
    turns = df.sparkSession.createDataFrame(turns, "cell int, turn_cell int, turn_sub long")
    links = links.join(F.broadcast(turns), "cell").select(
        F.col("cell").alias("own_cell"), F.col("sub").alias("own_sub"),
        F.when(F.col("next_sub").isNull(), F.col("turn_cell")).otherwise(F.col("cell")).alias("cell"),
        F.coalesce("next_sub", "turn_sub").alias("sub"))

    order = Window.partitionBy("cell", "sub").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = placed.withColumns({"next_text": F.lead("text").over(order), "nth": F.row_number().over(order)})
    inner = rows.filter("next_text IS NOT NULL").select("doc_id", "text", "next_text")
    firsts = rows.filter("nth = 1").select("cell", "sub", F.col("text").alias("next_text"))
    lasts = rows.filter("next_text IS NULL").select(
        F.col("cell").alias("own_cell"), F.col("sub").alias("own_sub"), "doc_id", "text")
    ends = lasts.join(links, ["own_cell", "own_sub"]).join(firsts, ["cell", "sub"]).select("doc_id", "text", "next_text")
    return inner.unionByName(ends)


def edited(text: Column, next_text: Column) -> Column:
    """The text with its second half replaced by as many characters of the next text, or all of them."""
    size = F.char_length(text)
    half = F.floor(size / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), size - half), F.substr(next_text, F.lit(1), half))


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness to it and to the next text's.

    Null texts count as empty and have an empty fingerprint; two empty
    fingerprints have likeness 1. Other columns than id and text play no part.
    """
    pairs = with_next(df, id_col, text_col).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    prints = pairs.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("print"), fingerprint(F.col("edited")).alias("edited_print"),
        hashes_of(fingerprint(F.col("next_text"))).alias("next_hashes"))
    own = hashes_of(F.col("print"))
    return prints.withColumns({
        "near_edited": let(own, lambda h: likeness(h, hashes_of(F.col("edited_print")))),
        "near_next": let(own, lambda h: likeness(h, F.col("next_hashes")))}).drop("next_hashes")
