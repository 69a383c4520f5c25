"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is cut into equal blocks of words, and its target is a whole number
of blocks: its quota of slots. The quotas, one behind another, are the
cumulative weights; slot i of the mix has the i-th van der Corput point (the
bits of i reversed), and the interval that the point falls in names the source.
As the number of slots is a power of two, every source gets exactly its quota,
spread so evenly that any run of slots holds every source close to its share.
Points behind the last quota are idle. The r-th slot of a source takes its block
r modulo its number of blocks, which are stretches of the source's documents in
shuffled order; later rounds repeat them. A slot's rank in its source follows
from its number alone, so no slots are sorted or gathered, and documents are
placed by running totals over ranges of the shuffle, so a hot source is never in
one task. Sources are rows of a table: there may be any number of them.

Defined results: null text has no words; a document without words is never
taken. A null source is a source of its own, last in order. Equal rows count
each. An empty table gives no rows. A source's quota is at most three times its
blocks, so no document is taken more than three times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import n_words, need_columns, running_totals, settled, spread_join, stage_table

#: Weights of the sources in order, repeating, and how often a source may be used up.
WEIGHTS, MOST = (1, 2, 3), 3
#: Words of a block: total size / BLOCKS, but within these bounds; and the least number of blocks of a source that has so many words.
BLOCKS, LEAST_BLOCK, LARGEST_BLOCK, LEAST_BLOCKS = 1 << 18, 16, 2048, 256
#: Points that are worked on together, and the slots of a task, about.
RUN, TASK = 1 << 12, 1 << 18


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight; what is above most times a size goes to the others."""
    total, level = sum(sizes), 0.0
    while True:
        full = [most * s <= level * w for s, w in zip(sizes, weights)]
        open_ = sum(w for w, f in zip(weights, full) if not f)
        new = (total - sum(most * s for s, f in zip(sizes, full) if f)) / open_ if open_ else level
        if new <= level:
            return [float(most * s) if most * s <= level * w else level * w for s, w in zip(sizes, weights)]
        level = new


def block_words(total: int) -> int:
    return max(LEAST_BLOCK, min(LARGEST_BLOCK, total // BLOCKS))


def sources(sized: DataFrame, weights: tuple = WEIGHTS, most: float = MOST) -> DataFrame:
    """A table of the sources by code point, null last: source, src, source_size, target,
    n_blocks, quota, base (words of the sources before) and first (their quotas).

    The level of water-filling is found as targets() does it, each step one aggregate.
    """
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"nil": F.col("source").isNull(), "one": F.lit(1).cast("long")})
    found = running_totals(found, ["nil", "source"], {"one": "src", "source_size": "base"})
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    found = stage_table(found.withColumn("weight", weight), "sources")
    total = found.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = most * F.col("source_size") <= level * F.col("weight")
        r = found.agg(F.sum(F.when(~full, F.col("weight"))).alias("open"), F.sum(F.when(full, F.col("source_size"))).alias("full")).first()
        new = (total - most * (r["full"] or 0)) / r["open"] if r["open"] else level
        if new <= level:
            break
        level = new
    size, least = F.col("source_size"), F.lit(float(most)) * F.col("source_size")
    block = block_words(total)
    found = found.withColumn("target", F.when(least <= level * F.col("weight"), least).otherwise(level * F.col("weight")))
    found = found.withColumn("n_blocks", F.least(size, F.greatest(F.lit(LEAST_BLOCKS), F.expr(f"(source_size + {block - 1}) div {block}"))).cast("long"))
    blocks = F.round(F.col("target") * F.col("n_blocks") / F.greatest(size, F.lit(1))).cast("long")
    found = found.withColumn("quota", F.least(blocks, F.lit(int(most)) * F.col("n_blocks")))
    return running_totals(found.drop("nil", "one", "weight"), ["src"], {"quota": "first"})


def _reversed(x: Column, bits: int) -> Column:
    """The lowest bits of x in reversed order."""
    return F.conv(F.reverse(F.lpad(F.conv(x.cast("string"), 10, 2), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def _earlier(point: Column, below: Column, bits: int) -> Column:
    """How many slots before a point's own have a point below a bound.

    Of the slots before, those that differ first (from the top) in a bit that is set
    in this slot's number have its lower point bits, a 0 in that bit's place and any
    bits above it in the point: they are evenly spaced, so a shift counts them.
    """
    total = F.lit(0).cast("long")
    for q in range(bits):
        least = point.bitwiseAND(F.lit((1 << q) - 1))
        n = F.shiftright(below - least + F.lit((2 << q) - 1), q + 1)
        n = F.least(F.greatest(n, F.lit(0).cast("long")), F.lit(1 << (bits - 1 - q)).cast("long"))
        total = total + F.when(point.bitwiseAND(F.lit(1 << q)) != 0, n).otherwise(F.lit(0).cast("long"))
    return total


def schedule(found: DataFrame) -> DataFrame:
    """slot, src, rank, block_no, round: what each slot of the mix takes.

    Runs of points meet the sources whose interval they overlap (as equal run
    numbers), so a source of any quota is dealt over many tasks.
    """
    n_slots = found.agg(F.sum("quota")).first()[0] or 0
    bits = max(0, n_slots - 1).bit_length()
    runs = F.sequence(F.expr(f"first div {RUN}"), F.expr(f"(first + quota - 1) div {RUN}"))
    parts = found.where("quota > 0").select("src", "n_blocks", "first", "quota", F.explode(runs).alias("run"))
    # A number of its own: by their few bytes the runs would be put together.
    parts = parts.repartition(max(1, -(-n_slots // TASK)), "run")
    low, high = F.greatest(F.col("first"), F.col("run") * RUN), F.least(F.col("first") + F.col("quota"), (F.col("run") + 1) * RUN) - 1
    points = parts.select("src", "n_blocks", "first", "quota", F.explode(F.sequence(low, high)).alias("point"))
    slots = points.withColumn("slot", _reversed(F.col("point"), bits))
    rank = _earlier(F.col("point"), F.col("first") + F.col("quota"), bits) - _earlier(F.col("point"), F.col("first"), bits)
    slots = slots.select("slot", "src", rank.cast("long").alias("rank"), "n_blocks")
    return slots.select("slot", "src", "rank", F.expr("rank % n_blocks").alias("block_no"), F.expr("rank div n_blocks").alias("round"))


def placed(sized: DataFrame, found: DataFrame) -> DataFrame:
    """Adds src, source_size, target, n_blocks and start: the document's place in its shuffled source."""
    # A struct of the source is a key that nulls have too.
    table = found.select(F.struct("source").alias("key"), "src", "source_size", "target", "n_blocks", "base")
    rows = sized.withColumns({"drawn": F.xxhash64(F.lit("source-mix"), "doc_id"), "key": F.struct("source")})
    rows = spread_join(rows, table, "key", "row").drop("key")
    rows = running_totals(rows, ["src", "drawn", "doc_id", "size", "row"], {"size": "start"})
    return rows.withColumn("start", F.col("start") - F.col("base")).drop("base", "drawn")


def _mixed(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (in words)."""
    need_columns(docs, "doc_id", "text", "source")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).withColumn("row", F.monotonically_increasing_id())
    sized = stage_table(sized, "sizes")
    found = sources(sized)
    rows = placed(sized, found)
    # Block b of a source of S words in n blocks has the words from b * S div n on: a document's
    # words lie in size * n / S + 2 blocks at most.
    of = lambda at: F.expr(f"(({at} + 1) * n_blocks - 1) div source_size")
    parts = rows.where("size > 0").select("src", "row", "start", "size", "source_size", "n_blocks", F.explode(F.sequence(of("start"), of("(start + size - 1)"))).alias("block_no"))
    begin, end = F.expr("block_no * source_size div n_blocks"), F.expr("(block_no + 1) * source_size div n_blocks")
    overlap = F.least(F.col("start") + F.col("size"), end) - F.greatest(F.col("start"), begin)
    takes = schedule(found).groupBy("src", "block_no").agg(F.count(F.lit(1)).alias("times"))
    taken = parts.join(takes, ["src", "block_no"]).groupBy("row").agg(F.sum(overlap * F.col("times")).alias("taken"))
    out = rows.join(taken, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@settled("mix")
def mix(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken (in words)."""
    return _mixed(docs).drop("source")


@settled("copies")
def _copies(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and how often rows of these go into the mix."""
    taken = _mixed(docs).where("size > 0").groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.sum("size").alias("total"))
    return taken.select("doc_id", "source", "size", F.expr("(2 * taken + total) div (2 * total)").alias("n")).where("n > 0")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: taken / size, rounded half up.

    Rows of the same doc_id, source and size are taken equally often.
    """
    copies = _copies(docs).toDF("__doc_id", "__source", "__size", "__copies")
    sized = docs.withColumn("__own_size", n_words(F.col("text")))
    same = docs["doc_id"].eqNullSafe(copies["__doc_id"]) & docs["source"].eqNullSafe(copies["__source"]) & (F.col("__own_size") == F.col("__size"))
    rows = sized.join(copies, same)
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
