"""Exact n-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row a document and a column a 5-word shingle. Its product with
its own transpose counts overlaps; the join keeps pairs with an overlap of at
least 4/9 of the two sizes together (Jaccard 0.8). Sizes bound what is needed:

- Documents with equal sets are one row.
- Columns have one global order. Of a row of n columns only the first n/5 + 1
  are multiplied: two rows whose first parts share nothing cannot reach 0.8.
- The order is by hash, but late columns come last: those of a bit table of the
  hot ones (in over HOT first parts, as counted in one of SAMPLE rows). So a
  passage that many documents share is multiplied only for rows that hold little
  else; these ("dense") are reread whole to order their columns. Any set of late
  columns gives the same result, so the sample decides only how many pairs are made.
- Pairs of the blocks go on only if their sizes are within 4 : 5, and then only
  if the Hamming distance of two parity bitmaps, which never exceeds the true
  difference of the sets, is within 1/9 of the sizes.
- What remains is counted exactly on the whole sets.

In blocks of hot columns, late or hot among dense rows, pairs are first made with two pivots each; after that
only pairs of different components are made, within size classes, if the hot
columns alone could reach the overlap. Pairs within a component need no check,
since the result is the components.

Defined results: a doc_id names one text; rows that repeat it are the same document. A null text and one without words has an empty set and links
with nothing; under 5 words the whole sequence is one shingle. Equal rows link.
Shingles are told apart by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import drop_stage, need_columns, release_heap, settled, slices, spread_join, stage_table
from gridloom.llm.components import components

#: Words of a shingle.
WORDS = 5
#: A column in more first parts than this is hot: counted in one of SAMPLE rows, by hash of their id.
HOT, SAMPLE = 64, 4
#: Bits of a sketch of keys: 4 MB, however many keys there are. It only spares shuffling what has no
#: partner; as more keys set more bits, it spares less, and results stay the same.
SKETCH = 1 << 25

_rng = np.random.default_rng(20_240_229)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES[_SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = _rng.integers(1, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 2 * len(_powers)), _STEP, np.uint64)
        step[0] = 1
        _powers = np.cumprod(step)
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted, distinct hashes of a text's shingles. A-Z are lower-cased first."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.int64)
    raw, starts = raw[starts[0] :], starts - starts[0]
    runs = np.diff(np.append(starts, len(raw)))
    place = np.arange(len(raw)) - np.repeat(starts, runs)
    word = _mixed(np.add.reduceat(_BYTES[raw] * _powers_to(int(runs.max()))[place], starts))
    n = len(word) - WORDS + 1
    if n < 1:
        short = np.append(word, np.uint64(len(word))) * np.append(_PLACES[: len(word)], _PLACES[WORDS])
        return _mixed(short.sum(dtype=np.uint64, keepdims=True)).view(np.int64)
    return np.unique(_mixed(sum(word[k : k + n] * _PLACES[k] for k in range(WORDS))).view(np.int64))


def first_part(n: int) -> int:
    """How many columns of a row must be multiplied."""
    return n // 5 + 1


def bitmap(columns: np.ndarray) -> np.ndarray:
    """Parity of the columns by hash, in 64-bit words: a power of two bits, twice the size or more."""
    bits = 1 << max(6, int(2 * len(columns) - 1).bit_length())
    odd = np.bincount((columns >> 7) & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def rows(docs: DataFrame) -> DataFrame:
    """doc_id, n, key (equal for equal sets), head (a bit over the first part), bits."""

    def run(batches):
        for batch in slices(batches):
            made = []
            for text in batch.column(1):
                s = shingles(text.as_py())
                n, k = len(s), first_part(len(s))
                made.append((n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[: k + k // 2 + 8], bitmap(s)) if n else (0, None, None, None))
            ints = pa.list_(pa.int64())
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.binary(), ints, ints))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "key", "head", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, head array<long>, bits array<long>")


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a sketch for each key."""
    mixed = _mixed(keys.view(np.uint64) ^ _STEP)
    return (mixed & np.uint64(SKETCH - 1)).astype(np.int64), (mixed >> np.uint64(39)).astype(np.int64) & (SKETCH - 1)


def sketch(keys: DataFrame):
    """A broadcast bit table in which two bits of each key of a one-column table are set.

    Tasks send the 64-bit words that they set, which are united by word: at most
    SKETCH / 64 of them come to the driver, whatever the number of keys.
    """

    def run(batches):
        found = np.zeros(SKETCH // 64, np.uint64)
        for batch in slices(batches):
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(found, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        word = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(found[word].view(np.int64))], ["word", "bits"])

    words = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = np.zeros(SKETCH // 64, np.uint64)
    found[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(found)


def _may_hold(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in a sketch."""
    a, b = ((found[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) for at in _places(keys))
    return (a & b).astype(bool)


def whole_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, columns (all of them, in order) of the documents in the stage table ids (column rep).

    Texts whose id is not in the ids' sketch are not shuffled.
    """
    wanted = sketch(ids.select("rep"))

    def choose(batches):
        for batch in batches:
            ids_ = batch.column(0)
            mask = _may_hold(wanted.value, pc.fill_null(ids_, 0).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(mask & ids_.is_valid().to_numpy(zero_copy_only=False)))

    def run(batches):
        for batch in slices(batches):
            made = pa.array([shingles(t.as_py()) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["rep", "columns"])

    # Merged at any size: a broadcast would put both functions in one task, with a Python process each.
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").mapInArrow(choose, "rep long, text string").join(ids.select("rep").hint("merge"), "rep", "left_semi")
    return texts.mapInArrow(run, "rep long, columns array<long>")


def _postings(table: DataFrame, among) -> DataFrame:
    """rep, n, t of the columns (array own) that may be in a sketch."""

    def run(batches):
        for batch in slices(batches):
            lists = batch.column(2)
            t = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            held = _may_hold(among.value, t)
            row = pa.array(row[held])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(t[held])], ["rep", "n", "t"])

    return table.select("rep", "n", "own").mapInArrow(run, "rep long, n long, t long")


def _first_parts(reps: DataFrame, late) -> DataFrame:
    """rep, n, own: the first part of each row without late columns; null where head has too few others (a dense row)."""

    def run(batches):
        for batch in slices(batches):
            lists, need = batch.column(2), first_part(batch.column(1).to_numpy(zero_copy_only=False))
            long = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            t = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), long)
            early = ~_may_hold(late.value, t)
            t, row = t[early], row[early]
            cold = np.bincount(row, minlength=len(lists))
            place = np.arange(len(row)) - (np.cumsum(cold) - cold)[row]
            dense = cold < need
            kept = np.where(dense, 0, need)
            ends = pa.array(np.concatenate(([0], np.cumsum(kept))).astype(np.int32))
            own = pa.ListArray.from_arrays(ends, pa.array(t[place < kept[row]], pa.int64()), mask=pa.array(dense))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], ["rep", "n", "own"])

    return reps.select("rep", "n", "head").mapInArrow(run, "rep long, n long, own array<long>")


def _told_late(rows: DataFrame, late) -> DataFrame:
    """rep, n, columns, and of these the late ones (hot1) and the others (cold1), in order."""

    def run(batches):
        for batch in slices(batches):
            lists = batch.column(2)
            t = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            mask, made = _may_hold(late.value, t), []
            for own in (mask, ~mask):
                ends = np.concatenate(([0], np.cumsum(np.bincount(row[own], minlength=len(lists))))).astype(np.int32)
                made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(t[own], pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["rep", "n", "columns", "hot1", "cold1"])

    return rows.select("rep", "n", "columns").mapInArrow(run, "rep long, n long, columns array<long>, hot1 array<long>, cold1 array<long>")


def _hot(reps: DataFrame) -> DataFrame:
    sample = reps.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)) == 0)
    return sample.select(F.explode("head").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > HOT // SAMPLE).select("t")


def _near_sizes(a: Column, b: Column) -> Column:
    return (5 * F.least(a, b) >= 4 * F.greatest(a, b))


def _no_longs() -> Column:
    return F.array().cast("array<long>")


def _sparse_pairs(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
    """The product of two blocks: x, y of rows that share a column t."""
    a, b = left.alias("a"), right.alias("b")
    near = _near_sizes(F.col("a.n"), F.col("b.n"))
    near = near & (F.col("a.rep") < F.col("b.rep") if ordered else F.col("a.rep") != F.col("b.rep"))
    joined = a.join(b, (F.col("a.t") == F.col("b.t")) & near)
    return joined.select(F.least("a.rep", "b.rep").alias("x"), F.greatest("a.rep", "b.rep").alias("y"))


def _within_bitmaps(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct pairs whose parity bitmaps allow the overlap."""
    bits = reps.select("rep", "n", "bits")
    a = bits.select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx"))
    b = bits.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"))
    joined = pairs.distinct().join(a, "x").join(b, "y")

    def folded(own: str, other: str) -> Column:
        half = F.floor(F.size(own) / 2).cast("int")
        halves = F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(own) > F.size(other), halves).otherwise(F.col(own))

    unlike = F.zip_with(folded("bx", "by"), folded("by", "bx"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(unlike, F.lit(0), lambda acc, c: acc + c)
    return joined.where(9 * apart <= F.col("nx") + F.col("ny")).select("x", "y", "nx", "ny")


def _counted(near: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v of the pairs in a stage table that link, counted on their whole sets."""
    with_x = sets.toDF("x", "sx").join(near, "x")
    both = with_x.join(sets.toDF("y", "sy"), "y").withColumn("inter", F.size(F.array_intersect("sx", "sy")))
    return stage_table(both.where(9 * F.col("inter") >= 4 * (F.col("nx") + F.col("ny"))).select(F.col("x").alias("u"), F.col("y").alias("v")), "links")


def _linked(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """node, component of rows with a pair that links.

    Each row's pair with its smallest partner is counted first, then the pairs
    that these left in different components; what those link are components.
    """
    near = stage_table(_within_bitmaps(pairs, reps), "near")
    if near.isEmpty():
        return near.select(F.col("x").alias("node"), F.col("y").alias("component"))
    ids = stage_table(near.select(F.explode(F.array("x", "y")).alias("rep")).distinct(), "near-ids")
    sets = stage_table(whole_rows(docs, ids), "sets")
    star = near.groupBy("y").agg(F.min(F.struct("x", "nx", "ny")).alias("p")).select("p.x", "y", "p.nx", "p.ny")
    links = _counted(stage_table(star, "star"), sets)
    found = stage_table(components(links), "components")
    a, b = found.toDF("x", "cx"), found.toDF("y", "cy")
    left = near.join(star.select("x", "y"), ["x", "y"], "left_anti").join(a, "x", "left").join(b, "y", "left")
    apart = F.coalesce("cx", "x") != F.coalesce("cy", "y")
    more = _counted(stage_table(left.where(apart).select("x", "y", "nx", "ny"), "left"), sets)
    return _with(found, more)


def _with(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) with more links; as they are, if there are none."""
    if links.isEmpty():
        return found
    return stage_table(components(links.select("u", "v").union(found.select(F.col("node").alias("u"), F.col("component").alias("v")))), "components")


def _dense_blocks(dense: DataFrame) -> DataFrame:
    """Of rows whose first part needs late columns (hot1): what each multiplies.

    own: its first columns that are neither late nor hot among dense rows; bridge:
    those of its first not-late columns that are hot among dense rows only; fill:
    the hot columns that complete its first part; f: its hot columns altogether.
    """
    cold = dense.select("rep", F.explode("cold1").alias("t"))
    more = stage_table(cold.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > HOT).select("t"), "hot")
    found = cold.join(more, "t").groupBy("rep").agg(F.collect_list("t").alias("hot2"))
    joined = dense.join(found, "rep", "left").withColumn("hot2", F.coalesce("hot2", _no_longs()))
    k = (F.floor(F.col("n") / 5) + 1).cast("int")
    joined = joined.withColumns({"k": k, "cold2": F.array_except("cold1", "hot2"), "hots": F.concat("hot1", "hot2")})
    missing = F.greatest(F.lit(0), F.col("k") - F.size("cold2"))
    return joined.select(
        "rep", "n",
        F.slice("cold2", F.lit(1), F.col("k")).alias("own"),
        F.array_intersect(F.slice("cold1", F.lit(1), F.col("k")), F.col("hot2")).alias("bridge"),
        F.slice(F.array_intersect("columns", "hots"), F.lit(1), missing).alias("fill"),
        F.size("hots").cast("long").alias("f"),
    )


def _pivot_pairs(blocks: DataFrame) -> DataFrame:
    """Of each hot block, pairs with two pivots: the row with least besides hot columns, and any row."""
    best = F.min(F.struct((F.col("n") - F.col("f")).alias("own"), "rep", "n")).alias("best")
    some = F.min(F.struct(F.xxhash64("rep", "t").alias("h"), "rep", "n")).alias("some")
    pivots = blocks.groupBy("t").agg(best, some).select("t", F.explode(F.array(*[F.struct(F.col(f"{p}.rep").alias("rep"), F.col(f"{p}.n").alias("n")) for p in ("best", "some")])).alias("p"))
    # A block's rows are dealt over parts: a passage may stand in any share of all documents.
    joined = spread_join(blocks.select("t", "rep", "n"), pivots.select("t", F.col("p.rep").alias("p"), F.col("p.n").alias("np")), "t", "rep")
    near = joined.where((F.col("rep") != F.col("p")) & _near_sizes(F.col("n"), F.col("np")))
    return near.select(F.least("rep", "p").alias("x"), F.greatest("rep", "p").alias("y"))


def _cross_pairs(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of a hot block's rows in different components that hot columns alone could link."""
    known = blocks.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = known.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / math.log(1.25)).cast("long"))
    split = known.groupBy("t").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("t")
    known = stage_table(spread_join(known, split, "t", "rep"), "blocks")
    a = known.withColumn("near_class", F.explode(F.array(*[F.col("size_class") + d for d in (-1, 0, 1)]))).alias("a")
    b = known.alias("b")
    shared = F.least("a.f", "b.f")
    # Rows of one hot block share no other column of their first parts, or another block has the pair.
    enough = 9 * shared >= 4 * (F.col("a.n") + F.col("b.n"))
    apart = (F.col("a.component") != F.col("b.component")) & (F.col("a.rep") < F.col("b.rep"))
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.near_class") == F.col("b.size_class"))
    joined = a.join(b, same & apart & enough & _near_sizes(F.col("a.n"), F.col("b.n")))
    return joined.select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y"))


def _linked_rows(docs: DataFrame, reps: DataFrame, firsts: DataFrame, late) -> DataFrame:
    """node, component of linked rows, where late columns go last in the order."""
    dense_ids = stage_table(firsts.where("own IS NULL").select("rep", "n"), "dense-ids")
    own = firsts.select("rep", "n", F.explode("own").alias("t"))
    if dense_ids.isEmpty():
        return _linked(_sparse_pairs(own, own, True), docs, reps)
    whole = stage_table(whole_rows(docs, dense_ids).join(dense_ids, "rep"), "dense-whole")
    dense = stage_table(_told_late(whole, late), "dense")
    dense = stage_table(_dense_blocks(dense), "dense-first")
    own = own.union(dense.select("rep", "n", F.explode("own").alias("t")))
    bridge = stage_table(dense.select("rep", "n", F.explode("bridge").alias("t")), "bridge")
    across = _postings(firsts, sketch(bridge.select("t")))
    fill = stage_table(dense.select("rep", "n", "f", F.explode("fill").alias("t")), "fill")
    pairs = _sparse_pairs(own, own, True).union(_sparse_pairs(bridge, across, False)).union(_pivot_pairs(fill))
    linked = _linked(pairs, docs, reps)
    cross = stage_table(_cross_pairs(fill, linked).distinct(), "cross")
    if not cross.isEmpty():
        linked = _with(linked, _linked(cross, docs, reps).select(F.col("node").alias("u"), F.col("component").alias("v")))
    return linked


def _distinct_rows(made: DataFrame) -> DataFrame:
    """key, rep (the smallest doc_id), n, head, bits of each set.

    Only rows whose key may stand in several rows, by a sketch, are shuffled.
    """
    made = made.where("n > 0 AND doc_id IS NOT NULL")
    several = sketch(made.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.xxhash64("key")))

    def chosen(wanted: bool) -> DataFrame:
        def run(batches):
            for batch in slices(batches):
                mask = _may_hold(several.value, batch.column(0).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array(mask == wanted))

        kinds = "mark long, key binary, doc_id long, n long, head array<long>, bits array<long>"
        return made.select(F.xxhash64("key").alias("mark"), "key", F.col("doc_id").cast("long").alias("doc_id"), "n", "head", "bits").mapInArrow(run, kinds)

    one = chosen(False).select("key", F.col("doc_id").alias("rep"), "n", "head", "bits")
    return one.union(chosen(True).groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "head", "bits")]))


@settled("near")
def join(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest linked doc_id), copy_of.

    copy_of is the smallest doc_id with the same set.
    """
    need_columns(docs, "doc_id", "text")
    made = stage_table(rows(docs), "rows")
    heads = stage_table(_distinct_rows(made), "heads")
    members = stage_table(made.select("doc_id", "n", "key"), "members")
    drop_stage(made)

    hot = stage_table(_hot(heads), "hot")
    late = sketch(hot)
    firsts = stage_table(_first_parts(heads, late), "first-parts")
    reps = stage_table(heads.select("key", "rep", "n", "bits"), "reps")
    drop_stage(heads)
    release_heap(docs.sparkSession)
    linked = _linked_rows(docs, reps, firsts, late)

    classes = reps.select("key", "rep").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = members.join(classes, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("copy_of"))
