"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document. The ledger keeps what was measured and one bit
for each rule that failed; a policy is a named, versioned set of rules, so that applying
another policy, or asking what a rule alone removes, reads the ledger and no text.
Everything is built from DataFrame expressions: no exchange, and rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonefold.llm.common import SPACES, UPPER, WORD, let, text_or_empty, unused

WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """name, its bit, and the condition (over the ledger's measurements) under which a text fails."""

    name: str
    bit: int
    fails: Callable[[dict[str, Column]], Column]


RULES = (
    Rule("too_few_words", 0, lambda m: m["n_words"] < 10),
    Rule("repeated_windows", 1, lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", 2, lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("duplicate_lines", 3, lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    Rule("word_length", 4, lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"])),
    Rule("shouting", 5, lambda m: (2 * m["n_upper"] > m["n_letters"]) & (m["n_upper"] > 20)),
    Rule("exclamations", 6, lambda m: (5 * m["n_exclamations"] > m["n_words"]) & (m["n_exclamations"] > 5)),
)


@dataclass(frozen=True)
class Policy:
    """A version's name and the rules that it applies."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_windows"))
FULL = Policy("full-1", tuple(r.name for r in RULES))


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of `window` words found twice or more, the first included.

    Windows are compared by 64-bit hashes. Texts whose windows all differ, nearly all of
    them, need no sort.
    """

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        starts = let(
            pairs,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(p, lambda x, k: (x["g"] == F.get(p, k - 1)["g"]) | (x["g"] == F.get(p, k + 1)["g"])),
                    lambda x: x["i"],
                )
            ),
        )
        steps = let(starts, lambda s: F.transform(s, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(s, k + 1) - x, F.lit(window)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def measured(h: Column) -> Column:
        n = F.size(h)
        grams = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return F.when(n <= window, F.lit(0)).otherwise(
            let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), measured).cast("long")


def measurements(text: Column) -> dict[str, Column]:
    """What the rules look at, by name. Long values; no text gives zeros."""
    removed = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    letters = UPPER + UPPER.lower()
    word_counts = let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_window_words(w).alias("rep")))
    return {
        "words": word_counts,
        "lines": line_counts,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": removed(SYMBOLS).cast("long"),
        "n_upper": removed(UPPER).cast("long"),
        "n_letters": removed(letters).cast("long"),
        "n_exclamations": removed("!").cast("long"),
    }


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclamations")


def with_ledger(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df with the measurements (`prefix` before each name) and `failed_bits` long.

    A null text counts as empty: it has no words and fails too_few_words. Columns of df with
    the names written are replaced; all others, rows and repeats of rows stay.
    """
    names = {n: f"{prefix}{n}" for n in MEASURED}
    own = unused(df, "_q")
    src = df.withColumn(own, text_or_empty(text))
    out = src.withColumns({f"{own}_{n}": c for n, c in measurements(F.col(own)).items()})
    found = {
        "n_words": F.col(f"{own}_words")["n"].cast("long"),
        "n_repeat_words": F.col(f"{own}_words")["rep"],
        "n_lines": F.col(f"{own}_lines")["n"].cast("long"),
        "n_dup_lines": F.col(f"{own}_lines")["dup"].cast("long"),
    }
    found |= {n: F.col(f"{own}_{n}") for n in MEASURED if n not in found}
    out = out.withColumn(f"{own}_ledger", F.struct(*[found[n].alias(n) for n in MEASURED]))
    m = {n: F.col(f"{own}_ledger")[n] for n in MEASURED}
    bits = sum((F.when(r.fails(m), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES), F.lit(0)).cast("long")
    out = out.withColumns({names[n]: m[n] for n in MEASURED} | {f"{prefix}failed_bits": bits})
    return out.drop(*[c for c in out.columns if c.startswith(own)])


def fails(policy: Policy, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) != 0


def ablations(ledger: DataFrame, policy: Policy = FULL, bits: str = "failed_bits") -> DataFrame:
    """For each rule of the policy: texts it fails, and texts that it alone removes. One row a rule.

    The ledger shrinks to one count for each pattern of bits (at most 2 to the number of rules), and
    the rules read those; an empty ledger gives zeros.
    """
    rules = [r for r in RULES if r.name in policy.rules]
    patterns = ledger.groupBy(F.col(bits).bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    of = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0))
    sums = [of(F.col("bits").bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f{r.bit}") for r in rules]
    sums += [of(F.col("bits") == (1 << r.bit)).alias(f"o{r.bit}") for r in rules]
    rows = F.array(*[F.struct(F.lit(policy.version).alias("version"), F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("failed"), F.col(f"o{r.bit}").alias("failed_alone")) for r in rules])
    return patterns.agg(*sums).select(F.inline(rows))


def keep_good(df: DataFrame, policy: Policy = FULL, text: str = "text") -> DataFrame:
    """The rows of df whose text passes the policy, with df's own columns."""
    own = unused(df, "_kept")
    return with_ledger(df, text, own).filter(~fails(policy, f"{own}failed_bits")).select(*[F.col(f"`{c}`") for c in df.columns])
