"""Secret scan with corpus-wide ownership frequency.

Candidates are found by pattern. The hash of each candidate's value is counted
over the whole corpus by distinct documents (as repositories, equal texts once)
and distinct sources (as owners). A value that several owners hold, or that very
many documents of one owner repeat, is a widely copied example; what else a single
owner holds looks live. Random-looking tokens that
the patterns do not name count as findings only if they look live.

Spans are in code points, the end exclusive. Defined results: null text counts
as empty and has none; a null source is an owner like any other; rows that
repeat a doc_id are one repository. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import need_columns, settled, spread_join, stage_table, text_or_empty

#: The patterns of the base kinds, and the least length of what counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: Tokens of letters and digits that no base kind names; kept if they look random and live.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{24,}"
#: A value in so many owners' documents is a copied example.
COPIED_OWNERS = 2
#: So is one in so many different documents, whoever owns them.
COPIED_REPOSITORIES = 100
KINDS = ("assign", "access", "hex", "opaque")
#: Matches of a text that are placed together.
BLOCK = 256


def _spans(text: Column, pattern: str, group: int | None = None, least: int = 0) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, leftmost and not overlapping.

    The pieces between matches give the places. A pattern whose group must have
    a least length is matched without that bound; what is too short is dropped after.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    lengths = F.transform(found, lambda m: F.length(m))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    # Struct fields stand in for local names, so each array is computed once.
    parts = F.array(F.struct(between.alias("between"), lengths.alias("lengths"), values.alias("values")))

    def place(p: Column) -> Column:
        n = F.size(p["lengths"])

        def at(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(p["between"], i))
            end = start + F.get(p["lengths"], i)
            span = F.struct(start.alias("start"), end.alias("end"), F.get(p["values"], i).alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        def block(acc: Column, k: Column) -> Column:
            """A block's own array grows by copying; the blocks before are passed on whole."""
            zero = F.struct(acc["at"].alias("at"), none.alias("out"))
            within = F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, n) - 1)
            return F.aggregate(within, zero, at, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["blocks"], F.array(r["out"])).alias("blocks")))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,value:string>>>").alias("blocks"))
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
        return F.when(n > 0, F.flatten(F.aggregate(blocks, zero, block, lambda acc: acc["blocks"]))).otherwise(none)

    spans = F.get(F.transform(parts, place), 0)
    return F.filter(spans, lambda s: F.length(s["value"]) >= least) if least else spans


def _found(text: Column, pattern: str, **how) -> Column:
    """The spans, worked out only for texts that have a match."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), _spans(text, pattern, **how)).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash and the spans of each kind."""
    need_columns(docs, "doc_id", "text", "source")
    text = F.col("text")
    rows = docs.select("doc_id", "source", text_or_empty().alias("text"))
    return rows.select(
        "doc_id",
        "source",
        F.sha2(text.cast("binary"), 256).alias("text_hash"),
        _found(text, ASSIGN, group=2, least=ASSIGN_LEAST).alias("assign"),
        _found(text, ACCESS).alias("access"),
        _found(text, HEX).alias("hex"),
        _found(text, OPAQUE).alias("opaque"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_repositories, n_owners over the corpus.

    Within an owner, documents of equal text are one repository, and so are rows that
    repeat a doc_id. Counted in steps of partial aggregation, so a value that a third of all
    documents hold meets no single task.
    """
    each = F.explode(F.concat(*KINDS))
    values = found.select("doc_id", "source", "text_hash", each.alias("s")).select(F.sha2(F.col("s.value").cast("binary"), 256).alias("value_hash"), "source", "text_hash", "doc_id")
    texts = values.groupBy("value_hash", "source", "text_hash").agg(F.min("doc_id").alias("doc_id"))
    pairs = texts.groupBy("value_hash", "source", "doc_id").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("value_hash", "source").agg(F.count(F.lit(1)).alias("n_repositories"))
    return owners.groupBy("value_hash").agg(F.sum("n_repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def _text_of(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with_kind(kind: str, order: int) -> Column:
    def named(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))

    return F.transform(kind, named)


@settled("findings")
def scan(docs: DataFrame) -> DataFrame:
    """One row a document: counts, base_sha256, spans, n_live, n_copied."""
    found = stage_table(candidates(docs).withColumn("row", F.monotonically_increasing_id()), "secrets")
    owned = ownership(found).where((F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repositories") >= COPIED_REPOSITORIES)).select("value_hash", F.lit(True).alias("copied"))
    flat = [_with_kind(kind, order) for order, kind in enumerate(KINDS)]
    spans = found.select("row", F.explode(F.concat(*flat)).alias("s")).withColumn("value_hash", F.sha2(F.col("s.value").cast("binary"), 256))
    # A value may stand in any share of all documents.
    judged = spread_join(spans, owned, "value_hash", "row", "left").select("row", "s", F.coalesce("copied", F.lit(False)).alias("copied"))
    plain = F.struct("s.start", "s.order", "s.end", "s.kind")
    per = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("s.kind") != "opaque", plain)).alias("base"),
        F.collect_list(F.when((F.col("s.kind") != "opaque") | ~F.col("copied"), plain)).alias("all"),
        F.count_if(~F.col("copied")).alias("n_live"),
        F.count_if(F.col("copied") & (F.col("s.kind") != "opaque")).alias("n_copied"),
    )
    out = found.select("row", "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]).join(per, "row", "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    return out.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS[:3]],
        F.sha2(_text_of(F.coalesce("base", none)).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.coalesce("all", none)).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
