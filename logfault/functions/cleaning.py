"""Message clean-up as column expressions: trim, prefix rules, masking, parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

PART_SEPARATOR = " | "
# All Unicode white space and the four separators of files, groups, records and units.
_SPACE = r"(?U:[\s\x1c-\x1f])"


def trim_lower(text) -> Column:
    """Remove white space of any kind at both ends, then lower-case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.col(text) if isinstance(text, str) else text,
                                                     f"^{_SPACE}+", ""), f"{_SPACE}+$", ""))


@dataclass(frozen=True)
class PrefixRule:
    """Rewrite a message that starts with ``prefix``.

    The result is ``head`` (if given), then parts ``keep_from`` to ``keep_to``
    (inclusive, to the end when None), then ``tail`` (if given), joined by the
    separator. The rule fires only if the message has exactly ``n_parts``
    parts (when set), holds every part it asks for, and its third part starts
    with ``third_part`` (when set).
    """

    prefix: str
    head: str | None = None
    keep_from: int = 1
    keep_to: int | None = None
    tail: str | None = None
    n_parts: int | None = None
    third_part: str | None = None

    def condition(self, msg: Column, parts: Column) -> Column:
        test = msg.startswith(self.prefix)
        if self.n_parts is not None:
            test = test & (F.size(parts) == self.n_parts)
        elif self.keep_to is not None:
            test = test & (F.size(parts) > self.keep_to)
        if self.third_part is not None:
            test = test & F.coalesce(F.get(parts, F.lit(2)).startswith(self.third_part), F.lit(False))
        return test

    def result(self, parts: Column) -> Column:
        if self.keep_to is None:
            kept = F.array_join(F.slice(parts, self.keep_from + 1, F.size(parts)), PART_SEPARATOR)
        else:
            kept = F.array_join(F.slice(parts, self.keep_from + 1,
                                        self.keep_to - self.keep_from + 1), PART_SEPARATOR)
        pieces = [F.lit(self.head)] if self.head is not None else []
        pieces.append(kept)
        if self.tail is not None:
            pieces.append(F.lit(self.tail))
        return F.concat_ws(PART_SEPARATOR, *pieces)


# Prefixes whose leading part is replaced, and the new leading part.
_HEADS = [
    ("memory dimm", "memory dimm"),
    ("memory #0x", "memory hex"),
    ("drive slot hdd", "drive slot hdd"),
    ("drive slot disk", "drive slot disk"),
    ("drive slot / bay hdd", "drive slot / bay hdd"),
    ("drive slot / bay disk", "drive slot / bay disk"),
    ("drive slot / bay nvmessd", "drive slot / bay nvmessd"),
    ("drive slot / bay bp", "drive slot / bay bp"),
    ("drive slot / bay rear", "drive slot / bay rear"),
    ("drive slot / bay front", "drive slot / bay front"),
    ("drive slot / bay #0x", "drive slot / bay hex"),
    ("power supply ps", "power supply ps"),
    ("drive slot front", "drive slot front"),
    ("processor #0x", "processor hex"),
    ("memory cpu0_", "memory cpu0_hex"),
    ("memory cpu1_", "memory cpu1_hex"),
    ("drive slot #0", "drive slot hex"),
    ("memory mem_ch", "memory mem_ch"),
    ("power supply #0", "power supply hex"),
]
# Fixed values.
OEM_MARK = "oem record"
OEM_INSIDE = "hex | oem record hex | seq"

# Rules of one round exclude each other, so a round is a single CASE; a later
# round sees the result of the round before.
DEFAULT_ROUNDS = (
    (
        PrefixRule("oem record", head="oem record", keep_from=1, keep_to=1, tail="seq"),
        PrefixRule("temperature", keep_from=0, keep_to=2, n_parts=4),
        PrefixRule("fan", head="fan", keep_from=1, keep_to=2, n_parts=4),
        *[PrefixRule(prefix, head=head) for prefix, head in _HEADS],
    ),
    (
        PrefixRule("temperature", keep_from=0, keep_to=1, tail="seq", third_part="reading"),
        PrefixRule("fan", head="fan", keep_from=1, keep_to=1, tail="seq", third_part="reading"),
    ),
)


def normalise_messages(df: DataFrame, msg: str = "msg", out: str = "msg_lower",
                       rounds=DEFAULT_ROUNDS) -> DataFrame:
    """Add the normalised message.

    Pass other ``rounds`` to handle another log dialect. Rules inside a round
    are tried in order and the first that fires wins.
    """
    df = df.withColumn(out, trim_lower(msg))
    df = df.withColumn(out, F.when(F.instr(F.col(out), OEM_MARK) > 1, F.lit(OEM_INSIDE))
                       .otherwise(F.col(out)))
    for rules in rounds:
        df = df.withColumn("_parts", F.split(F.col(out), r" \| ", -1))
        case = None
        for rule in rules:
            test = rule.condition(F.col(out), F.col("_parts"))
            value = rule.result(F.col("_parts"))
            case = F.when(test, value) if case is None else case.when(test, value)
        df = df.withColumn(out, F.coalesce(case, F.col(out))).drop("_parts")
    return df.withColumn(out, F.translate(F.col(out), "_", " "))


# Masking patterns in order, with the mask word.
MASKS = (
    (r"((?<=[^A-Za-z0-9])|^)(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))((?=[^A-Za-z0-9])|$)", "ID"),
    (r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)", "IP"),
    (r"((?<=[^A-Za-z0-9])|^)([0-9a-f]{6,} ?){3,}((?=[^A-Za-z0-9])|$)", "SEQ"),
    (r"((?<=[^A-Za-z0-9])|^)([0-9A-F]{4} ?){4,}((?=[^A-Za-z0-9])|$)", "SEQ"),
    (r"((?<=[^A-Za-z0-9])|^)(0x[a-f0-9A-F]+)((?=[^A-Za-z0-9])|$)", "HEX"),
    (r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)", "NUM"),
    (r'(?<=executed cmd )(".+?")', "CMD"),
)
WILDCARD = "<:*:>"


def mask(text, masks=MASKS) -> Column:
    """Replace ids, addresses, hex sequences, numbers and commands by mask words."""
    masked = F.col(text) if isinstance(text, str) else text
    for pattern, word in masks:
        masked = F.regexp_replace(masked, pattern, f"<:{word}:>")
    return masked


def safe_split(text, n: int, sep: str = "|") -> Column:
    """Trimmed part ``n`` (0-based); an empty string when there is none."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, f"[{sep}]", -1)
    return F.trim(F.coalesce(F.get(parts, F.lit(n)), F.lit("")))


def first_word(text) -> Column:
    return F.split_part(F.col(text) if isinstance(text, str) else text, F.lit(" "), F.lit(1))


def words(text) -> Column:
    """White-space tokens without empty ones."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(text, f"{_SPACE}+", -1), lambda token: token != "")


def prefix_words(text, prefix) -> Column:
    """``<prefix>_word`` for each word, prefix in lower case."""
    prefix = F.lower(F.col(prefix) if isinstance(prefix, str) else prefix)
    return F.transform(words(text), lambda token: F.concat(prefix, F.lit("_"), token))


def list_length(text, sep: str = ",") -> Column:
    return F.size(F.split(F.col(text) if isinstance(text, str) else text, sep, -1))


WORD_CHARACTER = r"[\p{L}\p{N}_]"


def vectoriser_tokens(text) -> Column:
    """Lower-cased runs of two or more word characters."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_CHARACTER + "{2,}"), F.lit(0))


def _grams_at(tokens: Column, n: int, starts: Column) -> Column:
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i - 1 + j) for j in range(n)]))


def ngrams(tokens: Column, low: int = 1, high: int = 3) -> Column:
    """All n-grams of ``low`` to ``high`` tokens, joined by a blank."""
    grams = []
    for n in range(low, high + 1):
        if n == 1:
            grams.append(tokens)
            continue
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))) \
            .otherwise(F.array().cast("array<int>"))
        grams.append(_grams_at(tokens, n, starts))
    return grams[0] if len(grams) == 1 else F.concat(*grams)


def value_counts(values: Column) -> Column:
    """``array<struct<value, n>>`` of an array, without a shuffle.

    Sorts the array and measures the distance between the starts of equal
    runs.
    """
    return F.transform(
        F.array(F.sort_array(values)),
        lambda a: F.transform(
            F.array(F.filter(F.sequence(F.lit(0), F.size(a)),
                             lambda i: (i < F.size(a)) & ((i == 0) | (F.get(a, i) != F.get(a, i - 1))))),
            lambda starts: F.transform(
                starts,
                lambda s, j: F.struct(F.get(a, s).alias("value"),
                                      (F.coalesce(F.get(starts, j + 1), F.size(a)) - s).cast("long").alias("n"))),
        )[0],
    )[0]
