"""Operator 10, quality rules by weak supervision (DataFrame functions only).

Rules read counts of a text and vote "good", "bad" or abstain. No rule decides alone: expectation
maximisation estimates how often each is right when the text is good and when it is bad, and a text is kept
when the posterior probability of "good", given all its votes, is at least ``keep_at``. A document of fewer
than 20 words, or with over 30 % of its words in repeated windows, fails whatever the rules say.

The counts come from one scan and never leave their row. EM sees the corpus only as a histogram of vote
patterns, at most 3 ** (number of rules) rows whatever the corpus size.

Defined cases: a null text is an empty one (no words, base_failed); a text without lines or windows has none
repeated; a text of any length is counted whole, in its own row; repeated rows get a row each; an empty table gives no rows; a text on which every rule abstains
gets the prior. Other columns pass through ``filter_documents`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import materialise, text_of

GOOD, BAD = "+", "-"

# Fixed values of the rules: (name, the bad condition, the good condition); neither means abstaining.
RULES = [
    ("length", "n_words < 20", "n_words >= 50"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines", "100 * n_dup_lines <= 10 * n_lines"),
    ("digits", "4 * n_digits > word_chars", "20 * n_digits <= word_chars"),
    ("vocabulary", "n_words >= 100 AND 10 * n_distinct < n_words", "n_words >= 20 AND 5 * n_distinct >= n_words"),
    ("special_characters", "100 * n_special > 10 * word_chars", "100 * n_special <= 6 * word_chars"),
]

# n_repeat_words: hash every window; only a text in which some hash occurs twice sorts them, finds the equal
# neighbours, and counts the words that the windows at those places cover together.
REPEATED = """
element_at(transform(array(
    CASE WHEN size(w) < 8 THEN cast(array() as array<bigint>) ELSE transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8))) END
), h -> CASE WHEN size(h) = size(array_distinct(h)) THEN 0L ELSE
    element_at(transform(array(array_sort(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), s ->
        aggregate(
            array_sort(transform(filter(s, (p, k) -> (k > 0 AND s[greatest(k - 1, 0)].x = p.x) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = p.x)), p -> p.i)),
            named_struct('n', 0L, 'end', 0),
            (a, i) -> named_struct('n', a.n + i + 8 - greatest(i, a.end), 'end', i + 8),
            a -> a.n)
    ), 1) END
), 1)
"""

# n_special counts what is neither a letter nor a digit of any script nor a blank.
PLAIN = r"[\\p{L}\\p{N}\\x20\\x09-\\x0D]+"
BLANKS = r"[\\x20\\x09-\\x0D]"


def statistics(text: Column) -> Column:
    """A struct of a text's counts; the word and line arrays are bound once as lambda variables."""
    body = f"""
    transform(array(array_remove(split(own_text, '{BLANKS}+'), '')), w -> named_struct(
        'n_words', cast(size(w) as bigint),
        'word_chars', cast(length(array_join(w, '')) as bigint),
        'n_distinct', cast(size(array_distinct(w)) as bigint),
        'n_repeat_words', {REPEATED}))[0]"""
    lines = rf"transform(array(filter(split(own_text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')), l -> named_struct('n_lines', cast(size(l) as bigint), 'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint)))[0]"
    symbols = "own_text"
    for c in "#*$%&|<>":
        symbols = f"replace({symbols}, '{c}', '')"
    others = f"named_struct('n_symbols', cast(length(own_text) - length({symbols}) as bigint), 'n_digits', cast(length(own_text) - length(regexp_replace(own_text, '[0-9]+', '')) as bigint), 'n_special', cast(length(regexp_replace(own_text, '{PLAIN}', '')) as bigint))"
    return F.struct(F.expr(body).alias("w"), F.expr(lines).alias("l"), F.expr(others).alias("o"))


COUNTS = {"n_words": "w", "word_chars": "w", "n_distinct": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l", "n_symbols": "o", "n_digits": "o", "n_special": "o"}


def with_votes(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``_quality`` of counts and the vote pattern, one character for each rule."""
    counted = docs.withColumn("own_text", text_of()).withColumn("_found", statistics(F.col("own_text"))).drop("own_text")
    counts = F.struct(*(F.col(f"_found.{part}.{name}").alias(name) for name, part in COUNTS.items()))
    counted = counted.withColumn("_counts", counts).drop("_found")
    def named(sql: str) -> str:
        for name in COUNTS:
            sql = sql.replace(name, f"_counts.{name}")
        return sql
    votes = F.concat(*(F.expr(f"CASE WHEN {named(bad)} THEN '{BAD}' WHEN {named(good)} THEN '{GOOD}' ELSE '0' END") for _, bad, good in RULES))
    base = F.expr(named("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    return counted.withColumn("_quality", F.struct(F.col("_counts.*"), votes.alias("votes"), base.alias("base_failed"))).drop("_counts")


@dataclass(frozen=True)
class LabelModel:
    """Prior probability of "good", and each rule's accuracy on good and on bad texts when it votes."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, votes: str) -> float:
        odds = log(self.prior / (1 - self.prior))
        for vote, a, b in zip(votes, self.on_good, self.on_bad):
            if vote == GOOD:
                odds += log(a / (1 - b))
            elif vote == BAD:
                odds += log((1 - a) / b)
        return 1 / (1 + exp(-max(-500.0, min(500.0, odds))))


def expectation_maximisation(patterns: dict[str, int], rounds: int = 100, prior: float = 0.8, on_good: float = 0.95, on_bad: float = 0.3, weight: float = 10.0) -> LabelModel:
    """Fits the label model to a histogram of vote patterns. It starts from rules that rarely vote "bad" on a good text,
    and that each see some kinds of bad text only; ``weight`` pseudo-votes of these starting values keep a rule
    that hardly ever votes near them. A rule may miss most bad texts, but its votes are never taken for the
    opposite of what they say: "bad" is no less likely on a bad text than on a good one."""
    n_rules = len(RULES)
    model = LabelModel(prior, (on_good,) * n_rules, (on_bad,) * n_rules)
    items = sorted(patterns.items())
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        good = 0.0
        right = [[weight * on_good, weight * on_bad] for _ in range(n_rules)]
        cast = [[weight, weight] for _ in range(n_rules)]
        for votes, n in items:
            p = model.posterior(votes)
            good += n * p
            for j, vote in enumerate(votes):
                if vote != "0":
                    cast[j][0] += n * p
                    cast[j][1] += n * (1 - p)
                    right[j][0] += n * p * (vote == GOOD)
                    right[j][1] += n * (1 - p) * (vote == BAD)
        bounded = lambda x, low: min(0.999, max(low, x))
        good_now = tuple(bounded(right[j][0] / cast[j][0], 0.501) for j in range(n_rules))
        bad_now = tuple(bounded(right[j][1] / cast[j][1], 1.001 - good_now[j]) for j in range(n_rules))
        model = LabelModel(bounded((good + weight * prior) / (total + weight), 0.5), good_now, bad_now)
    return model


def judged(voted: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """Adds ``probability`` and ``kept`` to rows with ``_quality``; ``voted`` is read twice, so materialise it."""
    spark = voted.sparkSession
    patterns = {r["votes"]: r["n"] for r in voted.groupBy(F.col("_quality.votes").alias("votes")).agg(F.count("*").alias("n")).collect()}
    model = expectation_maximisation(patterns)
    rows = [(votes, model.posterior(votes)) for votes in patterns]
    table = spark.createDataFrame(rows, "_votes string, _probability double")  # at most 3 ** len(RULES) rows
    out = voted.join(F.broadcast(table), voted["_quality.votes"] == table["_votes"], "left").drop("_votes")
    return out.withColumn("_kept", ~F.col("_quality.base_failed") & (F.col("_probability") >= keep_at))


def quality(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The counts, votes, posterior probability and verdict of every row of ``docs(doc_id, text)``."""
    voted = materialise(with_votes(docs.select("doc_id", "text")).drop("text"), "quality")
    return judged(voted, keep_at).select("doc_id", "_quality.*", F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))


def filter_documents(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    voted = materialise(with_votes(docs.select(F.struct("*").alias("_row"), "text")).drop("text"), "quality")
    return judged(voted, keep_at).filter("_kept").select("_row.*")
