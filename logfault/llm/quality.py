"""Quality rules as weak supervision.

Rules look at counts of a text and vote good, vote bad or abstain. No rule is
trusted on sight: expectation-maximisation estimates from the votes alone how
often each rule votes, and how, on good and on bad texts, and the posterior
probability of being good decides. The votes of all texts are first counted
per pattern of votes, at most ``3 ** rules`` rows, so each EM step is one pass
over that small table; it is all SQL functions and an expression per text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .common import let, text_of

#: Words in a window of repeated words.
WINDOW = 8
_SPACE = "\\x20\\x09-\\x0D"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{_SPACE}]+"), F.lit(0))


def length_without(text: Column, letters: str) -> Column:
    return F.char_length(F.translate(text, letters, "")).cast("bigint")


def repeated_words(found: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    def grams(ws: Column) -> Column:
        # Hashes of 1, 2, 4, 8 words: each from two neighbours of half the width.
        hashes, done = F.transform(ws, lambda w: F.xxhash64(w)), 1
        while done < width:
            step = min(done, width - done)
            hashes = let(hashes, _join_hashes(step))
            done += step
        return hashes

    def count(gs: Column) -> Column:
        return F.when(F.size(F.array_distinct(gs)) == F.size(gs), F.lit(0)).otherwise(let(_twins(gs), _covered(width)))

    return F.when(F.size(found) <= width, F.lit(0)).otherwise(let(grams(found), count)).cast("bigint")


def _join_hashes(step: int):
    def join(h: Column) -> Column:
        return F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), F.slice(h, step + 1, F.size(h)),
                          lambda a, b: F.xxhash64(a, b))
    return join


def _twins(gs: Column) -> Column:
    """Places of equal elements, ascending: sorted by value, an element with an equal neighbour."""
    ordered = F.sort_array(F.transform(gs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    twin = let(ordered, lambda o: F.filter(o, lambda x, i: (
        ((i > 0) & (F.get(o, i - 1)["g"] == x["g"])) | F.coalesce(F.get(o, i + 1)["g"] == x["g"], F.lit(False)))))
    return F.sort_array(F.transform(twin, lambda x: x["i"]))


def _covered(width: int):
    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda total, s: total + s)
    return covered


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{_SPACE}]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x)))).cast("bigint")


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per text that the rules look at; a null text counts as empty."""
    text = text_of(text_col)
    counted = df.select(F.col(id_col).alias("doc_id"), let(words(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        length_without(text, _BLANKS).alias("word_chars"),
        (F.char_length(text) - length_without(text, _SYMBOLS)).alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        (F.size(F.split(text, "\n", -1))).cast("bigint").alias("n_lines"),
        (F.char_length(text) - length_without(text, "!?")).alias("n_shouts"),
        (F.char_length(text) - length_without(F.lower(text), "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôößúùûü")).alias("n_letters"),
        (F.char_length(text) - length_without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÚÙÛÜ")).alias("n_upper"))
    return counted.select("doc_id", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words",
                          "n_lines", "n_shouts", "n_letters", "n_upper")


@dataclass(frozen=True)
class Rule:
    """Votes bad (-1) beyond ``bad``, good (1) below ``good``, else abstains (0); None never votes, null abstains."""

    name: str
    share: str
    good: float | None
    bad: float | None

    def vote(self) -> Column:
        x = F.expr(self.share)
        vote = F.lit(0)
        if self.good is not None:
            vote = F.when(x < self.good, 1).otherwise(vote)
        if self.bad is not None:
            vote = F.when(x > self.bad, -1).otherwise(vote)
        return vote.cast("tinyint")


#: Shares are of words or of the characters in words; texts without words give null and no vote. A text without one
#: defect may have another, so rules for defects abstain rather than vote good; the last rule votes good for prose.
RULES = (
    Rule("symbols", "n_symbols / nullif(word_chars, 0)", None, 0.1),
    Rule("repeated_words", "n_repeat_words / nullif(n_words, 0)", None, 0.3),
    Rule("lines", "n_dup_lines / n_lines", None, 0.4),
    Rule("shouting", "n_shouts / nullif(n_words, 0)", None, 0.3),
    Rule("capitals", "n_upper / nullif(n_letters, 0)", None, 0.4),
    Rule("letters", "1 - n_letters / nullif(word_chars, 0)", None, 0.25),
    Rule("prose", "greatest(2 * n_symbols / nullif(word_chars, 0), n_repeat_words / nullif(n_words, 0), n_shouts / nullif(n_words, 0), "
                  "n_upper / nullif(n_letters, 0), 1 - n_letters / nullif(word_chars, 0))", 0.2, None),
)


@dataclass(frozen=True)
class Model:
    """The prior of good and, for each rule, log P(vote | good) - log P(vote | bad) by vote."""

    prior: float
    weights: dict[str, dict[int, float]]

    def posterior(self) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, by_vote in self.weights.items():
            vote = F.col(name)
            total = total + F.when(vote == 1, by_vote[1]).when(vote == -1, by_vote[-1]).otherwise(by_vote[0])
        return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(700.0)), F.lit(-700.0))))


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], names: Sequence[str], rounds: int = 50,
        prior: float = 0.8, accuracy: float = 0.8, smooth: float = 1.0) -> Model:
    """EM over counted patterns of votes.

    It starts from rules whose votes are right with probability ``accuracy`` and
    adds ``smooth`` to every count, so unseen votes keep a finite weight. The
    prior stays between 0.01 and 0.99.
    """
    votes = (-1, 0, 1)
    right, wrong = accuracy / 2, (1 - accuracy) / 2
    good = [{1: right, -1: wrong, 0: 0.5} for _ in names]
    bad = [{1: wrong, -1: right, 0: 0.5} for _ in names]
    for _ in range(rounds):
        sums = [0.0, 0.0]
        tally = [[dict.fromkeys(votes, smooth) for _ in names] for _ in range(2)]
        for pattern, count in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(g[v] / b[v]) for g, b, v in zip(good, bad, pattern))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            for side, share in enumerate((p * count, (1 - p) * count)):
                sums[side] += share
                for seen, v in zip(tally[side], pattern):
                    seen[v] += share
        prior = min(0.99, max(0.01, (sums[0] + smooth) / (sum(sums) + 2 * smooth)))
        good, bad = ([{v: seen[v] / sum(seen.values()) for v in votes} for seen in side] for side in tally)
    return Model(prior, {n: {v: math.log(g[v] / b[v]) for v in votes} for n, g, b in zip(names, good, bad)})


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES,
           least: float = 0.5) -> DataFrame:
    """Counts, ``base_failed``, the posterior ``quality`` and ``kept`` for every row of ``df``.

    Base rules come first: under 20 words, or over 30 % of the words in
    repeated windows. Null and empty texts have no words and fail. Repeated
    rows are judged alike; columns other than id and text are not read.
    """
    counted = materialise(measures(df, id_col, text_col).withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))), "measures")
    votes = counted.withColumns({r.name: r.vote() for r in rules})
    names = [r.name for r in rules]
    # At most 3 ** rules rows, whatever the table.
    patterns = [(tuple(r)[:-1], r["count"]) for r in votes.groupBy(*names).count().orderBy(*names).collect()]
    model = fit(patterns, names)
    return (votes.withColumn("quality", model.posterior())
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "quality"))
