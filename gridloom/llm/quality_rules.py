"""Quality rules by weak supervision.

Each rule looks at one trait and votes good (1) or bad (0) on a document, or
abstains (-1) between its two bounds; several rules see each kind of fault. How
often each combination of votes occurs is counted over all documents. On these
counts expectation maximisation estimates how many documents are good and how
many bad in each way (KINDS), and for each of these classes apart how often each
rule gives each of its three votes. A document is kept when its posterior quality
is at least MIN_POSTERIOR and it passes the base rules. So a bad vote that the
other rules contradict counts as little as that rule has proved to agree with them.

Defined results: null text has no words, so it fails the base rules, as does
any text under BASE_WORDS words. Rows are judged one by one: ties and repeated
rows get the same verdict. With no rows there is nothing to estimate and no
result rows. Whole texts are measured; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACES, need_columns, settled, stage_table, text_or_empty, words

#: The characters that count as symbols, and the base rules' bounds.
SYMBOLS, BASE_WORDS, BASE_REPEATED_PERCENT = "#*$%&|<>", 10, 20
#: Words of a window in which repetition is looked for.
WINDOW = 5
MIN_POSTERIOR = 0.5
#: Ways in which documents are bad, each with the rules that look for it.
KINDS = {
    "symbols": ("symbols", "plain"),
    "shouting": ("upper", "marks", "plain"),
    "numbers": ("digits", "plain", "word_length"),
    "repetition": ("repeats", "stutter", "distinct", "dup_lines"),
}
#: Steps of the estimation, and the change of a share that ends it.
STEPS, SETTLED = 300, 1e-8
#: What the estimates start from: the share of good documents, the others sharing the rest;
#: how often a rule votes rightly and wrongly. And the documents each share is smoothed with.
START_GOOD, START_RIGHT, START_WRONG, SMOOTHING = 0.8, 0.7, 0.1, 1.0
VOTES = (-1, 0, 1)
#: A word of letters with one mark behind it at most.
PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}+(?:['’-]\p{L}+)*[.,;:!?]?(?![^\x20\x09-\x0D])"


def _windows(w: Column) -> Column:
    """The hash of each 5-word window, in order."""
    last = F.size(w) - WINDOW
    made = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(last < 1, F.array().cast("array<long>")).otherwise(made)


def _covered(hashes: Column) -> Column:
    """Words within 5-word windows that the text holds twice or more; the costly part is
    for texts that repeat."""
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(pairs: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return F.get(pairs, j - 1)["h"].eqNullSafe(x["h"]) | F.get(pairs, j + 1)["h"].eqNullSafe(x["h"])

        return F.array_sort(F.transform(F.filter(pairs, same), lambda x: x["i"]))

    def union(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

        def step(acc: Column, at: Column) -> Column:
            return F.struct((at + WINDOW).alias("end"), (acc["n"] + at + WINDOW - F.greatest(acc["end"], at)).alias("n"))

        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    # A lambda over a one-element array computes its argument once.
    once = F.transform(F.array(order), lambda pairs: union(repeated(pairs)))
    return F.when(some, F.get(once, 0)).otherwise(F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules look at, all exact counts over the whole text."""
    need_columns(docs, "doc_id", "text")
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.select("doc_id", "text", words(text).alias("w"), lines.alias("lines"), F.translate(text, SPACES, "").alias("bare"))
    rows = rows.withColumn("windows", _windows(F.col("w")))
    bare = F.col("bare")

    def count(pattern: str) -> Column:
        return F.regexp_count(bare, F.lit(pattern)).cast("long")

    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length("bare").cast("long").alias("word_chars"),
        (F.length("bare") - F.length(F.translate(bare, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("windows")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x, i: (i > 0) & F.get("w", i - 1).eqNullSafe(x))).cast("long").alias("n_stutters"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[0-9]").alias("n_digits"),
        count(r"[.!?,;:]").alias("n_marks"),
        F.coalesce(F.regexp_count(text, F.lit(PLAIN)), F.lit(0)).cast("long").alias("n_plain"),
        F.size(F.array_distinct(F.transform("w", lambda x: F.xxhash64(x)))).cast("long").alias("n_distinct"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, Column]:
    """Each rule's vote, from the document's measures."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    length, upper = _ratio("word_chars", "n_words"), _ratio("n_upper", "word_chars")
    symbols, digits, marks = _ratio("n_symbols", "n_words"), _ratio("n_digits", "word_chars"), _ratio("n_marks", "n_words")
    lines, repeats, plain = _ratio("n_dup_lines", "n_lines"), _ratio("n_repeat_words", "n_words"), _ratio("n_plain", "n_words")
    stutters, distinct = _ratio("n_stutters", "n_words"), _ratio("n_distinct", "n_words")
    many = F.col("n_words") >= 50
    return {
        "word_length": vote((length < 2.5) | (length > 14), length.between(3.5, 9)),
        "symbols": vote(symbols > 0.1, symbols < 0.02),
        "upper": vote(upper > 0.3, upper < 0.12),
        "digits": vote(digits > 0.3, digits < 0.05),
        "marks": vote((marks > 0.7) | (many & (marks < 0.005)), marks.between(0.02, 0.4)),
        "plain": vote(plain < 0.7, plain > 0.85),
        "dup_lines": vote(lines > 0.3, lines < 0.1),
        "repeats": vote(repeats > 0.15, repeats < 0.05),
        "stutter": vote(stutters > 0.1, stutters < 0.03),
        "distinct": vote(many & (distinct * F.sqrt(F.col("n_words").cast("double")) < 2.5), ~many | (distinct * F.sqrt(F.col("n_words").cast("double")) > 4)),
    }


@dataclass(frozen=True)
class Estimate:
    """The share of each class, good first, and of each class and rule the shares of the
    rule's votes (in the order of VOTES)."""

    classes: tuple[float, ...]
    votes: tuple[tuple[tuple[float, ...], ...], ...]

    def posteriors(self, patterns: np.ndarray) -> np.ndarray:
        """P(class | votes): a row a pattern of votes, a column a class."""
        told = np.log(np.array(self.votes))
        logs = np.log(np.array(self.classes)) + sum(told[:, j, patterns[:, j] + 1].T for j in range(patterns.shape[1]))
        parts = np.exp(logs - logs.max(axis=1, keepdims=True))
        return parts / parts.sum(axis=1, keepdims=True)


def start(names: list[str]) -> Estimate:
    """Rules vote rightly: bad in the classes that they look for and good in all others."""
    bad, good = ((1 - START_RIGHT - START_WRONG, *x) for x in ((START_RIGHT, START_WRONG), (START_WRONG, START_RIGHT)))
    kinds = [(), *KINDS.values()]
    shares = [START_GOOD] + [(1 - START_GOOD) / len(KINDS)] * len(KINDS)
    return Estimate(tuple(shares), tuple(tuple(bad if name in kind else good for name in names) for kind in kinds))


def estimate(patterns: list[tuple[tuple[int, ...], int]], now: Estimate) -> Estimate:
    """Expectation maximisation over vote patterns and their counts.

    There are at most 3^rules patterns, whatever the number of documents.
    """
    if not patterns:
        return now
    seen, n = np.array([p for p, _ in patterns]), np.array([float(n) for _, n in patterns])
    n_classes, total = len(now.classes), n.sum()
    for _ in range(STEPS):
        weights = now.posteriors(seen) * n[:, None]
        classes = (weights.sum(axis=0) + SMOOTHING / n_classes) / (total + SMOOTHING)
        sums = np.stack([weights.T @ (seen == v) for v in VOTES], axis=2) + SMOOTHING / len(VOTES)
        votes = sums / sums.sum(axis=2, keepdims=True)
        change = np.abs(classes - now.classes).max()
        now = Estimate(tuple(classes.tolist()), tuple(tuple(map(tuple, rules)) for rules in votes.tolist()))
        if change < SETTLED:
            break
    return now


@settled("quality")
def judge(docs: DataFrame) -> DataFrame:
    """One row a document: the measures, base_failed, kept and the posterior."""
    spark, named = docs.sparkSession, rules()
    measured = stage_table(measures(docs), "measures")
    voted = measured.select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in named.items()])
    votes = [f"vote_{k}" for k in named]
    counts = voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted((tuple(r[v] for v in votes), r["n"]) for r in counts)
    found = estimate(patterns, start(list(named)))
    # One row a pattern of votes, of which there are at most 3^rules.
    good = found.posteriors(np.array([p for p, _ in patterns], int).reshape(-1, len(votes)))[:, 0]
    quality = [(*pattern, float(q)) for (pattern, _), q in zip(patterns, good)]
    told = spark.createDataFrame(quality, ", ".join(f"{v} int" for v in votes) + ", quality double")
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATED_PERCENT * F.col("n_words"))
    out = voted.join(F.broadcast(told), votes).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("quality") >= MIN_POSTERIOR)
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*first, kept.alias("kept"), "quality", *votes)
