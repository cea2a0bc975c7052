"""Quality rules: one table of thresholds, compiled into one Spark projection.

Everything is built-in Spark expressions: no user functions, no shuffle, one narrow pass. Each rule is a row of RULES:
a ratio (numerator and denominator are names of measures), and the range in which a document passes. `verdict`
turns the table into one boolean column.

Cases: a null or empty text has no words; all its counts are 0, it fails the base rule and isn't kept. Repeated rows and
repeated or null ids are each judged alone; there is no order, so no ties. Very long texts are judged whole. Other columns are neither read nor changed; a
column of the input that has the name of a measure stays what it was in `keep_good`.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import SPACE, whole_text

SYMBOLS = "#*$%&|<>"
#: The most frequent function words of English, German, Spanish and French.
STOP_WORDS = (
    "the of and to in is that for it was with as on are be at by this an or "
    "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als "
    "de la que el en y los del se las por un una con no su es al lo "
    "le les et des est dans qui du une pour pas au sur ne par plus"
).split()
WINDOW = 5


class Rule(NamedTuple):
    name: str
    numerator: str
    denominator: str
    least: float
    most: float
    from_words: int  # shorter documents pass: their ratios say little


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0, 1),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.15, 1),
    Rule("capital_letters", "n_capitals", "word_chars", 0.0, 0.5, 10),
    Rule("exclamations_per_word", "n_exclaims", "n_words", 0.0, 0.5, 10),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, 1.0, 30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.5, 1),
    Rule("words_with_letters", "n_letter_words", "n_words", 0.6, 1.0, 10),
)


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), characters, text)


def measures(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """`carry`, and a struct `m` with the counts of each text. Columns in between start with two underscores."""
    kept = [F.col(f"`{c}`") for c in carry]
    step = docs.select(*kept, whole_text(text_col).alias("__t"))
    step = step.select(*kept, "__t", F.array_remove(F.split("__t", f"{SPACE}+"), "").alias("__w"), F.split("__t", "\n").alias("__l0"))
    blank = " \t\n\x0b\x0c\r"
    step = step.select(*kept, "__t", "__w", F.filter("__l0", lambda x: F.btrim(x, F.lit(blank)) != "").alias("__l"))
    word = lambda i: F.get(F.col("__w"), i)
    step = step.select(
        *kept, "__t", "__w", "__l",
        F.when(F.size("__w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("__w") - WINDOW), lambda i: F.xxhash64(*[word(i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("__g"),
    )
    # Most texts repeat no window, so that only those that do are sorted.
    step = step.select(*kept, "__t", "__w", "__l", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.col("__g")).otherwise(F.array().cast("array<bigint>")).alias("__r"))
    step = step.select(*kept, "__t", "__w", "__l", F.array_sort(F.transform("__r", lambda g, i: F.struct(g.alias("g"), i.alias("i")))).alias("__s"))
    same = lambda x, i: F.coalesce(F.get(F.col("__s"), i)["g"] == x["g"], F.lit(False))
    step = step.select(*kept, "__t", "__w", "__l", F.array_sort(F.transform(F.filter("__s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])).alias("__p"))
    covered = F.aggregate(F.transform("__p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__p"), k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    text, chars = F.col("__t"), F.char_length("__t")
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    m = {
        "n_words": F.size("__w"),
        "word_chars": F.char_length(F.array_join("__w", "")),
        "n_symbols": chars - F.char_length(_without(text, SYMBOLS)),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": covered,
        "n_lines": F.size("__l"),
        "n_capitals": F.octet_length("__t") - F.octet_length(F.regexp_replace("__t", "[A-Z]+", "")),
        "n_exclaims": chars - F.char_length(_without(text, "!")),
        "n_stop_words": F.size(F.filter("__w", lambda w: F.array_contains(stop, F.lower(w)))),
        "n_letter_words": F.size(F.filter("__w", lambda w: w.rlike(r"\p{L}"))),
    }
    return step.select(*kept, F.struct(*[v.cast("long").alias(k) for k, v in m.items()]).alias("m"))


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < 10) | (100 * F.col(f"{m}.n_repeat_words") > 20 * F.col(f"{m}.n_words"))


def verdict(rules: tuple[Rule, ...] = RULES, m: str = "m") -> Column:
    """True where every rule passes. Ratios over nothing count as 0 in range."""

    def passes(r: Rule) -> Column:
        ratio = F.try_divide(F.col(f"{m}.{r.numerator}"), F.col(f"{m}.{r.denominator}"))
        return (F.col(f"{m}.n_words") < r.from_words) | F.coalesce(ratio.between(r.least, r.most), F.lit(True))

    return reduce(lambda a, b: a & b, map(passes, rules))


def judge(docs: DataFrame, carry: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`carry`, the measures `m`, `base_failed`, `kept`."""
    kept = [F.col(f"`{c}`") for c in carry]
    out = measures(docs, carry, text_col).select(*kept, "m", base_failed().alias("__b"), verdict(rules).alias("__v"))
    return out.select(*kept, "m", F.col("__b").alias("__base_failed"), (~F.col("__b") & F.col("__v")).alias("__kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs` that pass, with all their columns and nothing else."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_col).alias("__text"))
    # A condition that the optimizer takes for nondeterministic, though it's always true, keeps the filter above the
    # projection. Pushed below, it would have all measures written out in it, with a split of the text for each word.
    stays = F.col("__kept") & (F.spark_partition_id() >= 0)
    good = judge(packed, ["__row"], "__text", rules).select("__row", stays.alias("__stays")).where("__stays")
    return good.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
