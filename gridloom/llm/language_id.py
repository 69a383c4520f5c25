"""Language identification by rank-order n-gram profiles.

A profile is the most frequent 1- to 3-grams of letters (word boundaries count
as a letter) in order of frequency. A document goes to the language whose
profile is nearest by out-of-place distance: the sum, over the document's own
most frequent n-grams, of how far apart the two ranks are, a missing n-gram
counting as the whole profile length.

Defined results: a null text, or one without a letter, is `und` with score 0;
with no labelled row at all every text is. Equal distances go to the first
language by code point. The score is 1 less the distance over the largest
possible one. Rows without a label, or with null text, teach nothing.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import need_columns, slices

#: Length of a profile.
PROFILE = 300
#: The fit's bound: about so many labelled rows of each language are counted.
TRAIN_ROWS = 4000
#: Rows whose n-grams a task holds before it adds them up.
FIT_ROWS = 100
#: Below this score a document is taken to be in none of the learned languages.
MIN_SCORE = 0.05
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, packed in 63 bits, and how often each occurs."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return none
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    runs = np.concatenate(([0], np.where(letter, points, 0)[keep], [0]))
    runs = runs[: len(runs) - (not letter[-1])]
    two = runs[:-1] << 21 | runs[1:]
    three = two[:-1] << 21 | runs[2:]
    every = np.concatenate((runs[runs > 0], two[two > 0] | 1 << 42, three | 1 << 62))
    return np.unique(every, return_counts=True)


def profile(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, ties by key."""
    return keys[np.lexsort((keys, -counts))[:PROFILE]]


class Profiles:
    """Learned profiles, as one sorted table of n-grams with a rank a language."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.languages = sorted(ranked)
        self.keys = np.unique(np.array([k for v in ranked.values() for k in v], np.int64))
        self.ranks = np.full((len(self.languages), len(self.keys) + 1), -1, np.int64)
        for row, language in enumerate(self.languages):
            at = np.searchsorted(self.keys, np.array(ranked[language], np.int64))
            self.ranks[row, at] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = grams(text)
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        own = profile(keys, counts)
        at = np.searchsorted(self.keys, own)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == own[known]
        ranks = self.ranks[:, np.where(known, at, len(self.keys))]
        apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(apart))
        return self.languages[best], float(1 - apart[best] / (PROFILE * len(own)))


def in_fold(doc_id: Column, fold: int, folds: int = 3) -> Column:
    """Whether a document is in a fold, by the crc32 of its id as text; null ids are in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Profiles:
    """Learns from columns doc_id, text, lang; about train_rows rows a language.

    Rows are chosen by a hash of doc_id against each language's row count, so
    no language's rows meet in one task; n-gram counts are summed from partial
    counts. Only PROFILE rows a language reach the driver.
    """
    need_columns(labelled, "doc_id", "text", "lang")
    rows = labelled.where("lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles({})
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, train_rows / n))])
    drawn = F.pmod(F.xxhash64(F.lit("language-id"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where((drawn < share[F.col("lang")]) & F.col("text").isNotNull())

    def count(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, parts: list) -> None:
            keys = np.concatenate([k for k, _ in parts])
            u, where = np.unique(keys, return_inverse=True)
            sums[lang] = u, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)

        for batch in slices(batches, FIT_ROWS):
            new: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                new.setdefault(lang, []).append(grams(text.as_py()))
            for lang, parts in new.items():
                add(lang, parts + ([sums[lang]] if lang in sums else []))
        for lang, (keys, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    ranked: dict[str, list] = {lang: [] for lang in sizes}
    for r in top.orderBy("lang", "rank").collect():
        ranked[r["lang"]].append(r["gram"])
    return Profiles({k: v for k, v in ranked.items() if v})


def predict(docs: DataFrame, model: Profiles, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs with the predicted language and its score, which replace columns of these names."""
    docs = docs.drop(pred, score)

    def run(batches):
        for batch in batches:
            made = [model.predict(t.as_py()) for t in batch.column(text)]
            columns = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, pred, score])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, `{pred}` string, `{score}` double")


def accepted(pred: str = "lang_pred", score: str = "score") -> Column:
    """Whether a document is in one of the learned languages."""
    return (F.col(pred) != UNKNOWN) & (F.col(score) >= MIN_SCORE)
