"""Chat formatting as a prefix tree.

Conversations that share their first turns share a path of nodes from a root.
Each node is formatted and emitted once, in depth-first order; a conversation is
the path to its last node. A node's position ids run on from its parent's, and
its attention covers its own segment and the emitted intervals of its ancestors.

Paths are dealt by range in depth-first order (equal ones by conversation), so a
first turn or a whole conversation that very many share is dealt over many
tasks. Within a range a path shares with the one before it what they begin with,
and only the rest is emitted; a task holds one path at a time. The first path of
a range may begin like the last one of the range before: a table of one row a
range says how much of it, and where it was emitted. Conversations are read back
from the emitted nodes in the same order, by offset.

The template is <|turn|>role<|text|>text<|end|>. Control strings inside a role or
text get a backslash after their first character, and backslashes are doubled,
so the output reads back exactly. The loss mask is on assistants' texts.

Defined results: null roles and texts count as empty; turns are ordered by turn
(null first), then role and text, and equal rows are turns of their own. A null
conv_id is one conversation, and a conversation is read as one row. No rows give
no rows. Lengths and offsets are in code points.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.llm.common import need_columns, settled, stage_table

#: The template's marks.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What starts a control string, of this template and of others in use:
#: <|...|>, <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
CONTROL = re.compile(r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN_PATTERN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
LOSS_ROLE = "assistant"
#: The table of ranges is broadcast if its paths have so many nodes at most; else it is shuffled.
ENTRIES = 1 << 18
#: What a row of the emitted table is: a node, a conversation, and the first and the last path of a range.
NODE, CONVERSATION, FIRST, LAST = range(4)

_SPANS = "array<struct<begin:long,end:long>>"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id and, of each node on its path, key, role and segment.

    A node's key is a digest of its parent's key, its role and its text.
    """
    need_columns(conversations, "conv_id", "turn", "role", "text")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    turns = turns.select("conv_id", "turns.role", "turns.text")

    def run(batches):
        for batch in batches:
            keys, segments = [], []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                key, made = b"", []
                for role, text in zip(roles, texts):
                    said, spoken = role.encode(), text.encode()
                    key = hashlib.blake2b(b"%s%d:%s%s" % (key, len(said), said, spoken), digest_size=16).digest()
                    made.append(key)
                keys.append(made)
                segments.append([TURN + escape(r) + TEXT + escape(t) + END for r, t in zip(roles, texts)])
            columns = [batch.column(0), pa.array(keys, pa.list_(pa.binary())), batch.column(1), pa.array(segments, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "keys", "roles", "segments"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(run, f"conv_id {kind}, keys array<binary>, roles array<string>, segments array<string>")


@dataclass(frozen=True)
class Step:
    """A node of the path at hand: where it was emitted, the length of the path down to it, and its united spans."""

    key: bytes
    begin: int
    end: int
    whole: int
    spans: list[dict]


def _below(above: Step | None, key: bytes, begin: int, length: int) -> Step:
    """The next node on a path. The spans are copied, as each node carries its own."""
    if above is None:
        return Step(key, begin, begin + length, length, [{"begin": begin, "end": begin + length}])
    spans = above.spans[:]
    if spans[-1]["end"] == begin:
        spans[-1] = {"begin": spans[-1]["begin"], "end": begin + length}
    else:
        spans.append({"begin": begin, "end": begin + length})
    return Step(key, begin, begin + length, above.whole + length, spans)


def _common(a: list, b: list) -> int:
    return sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(a, b)))


def _walk(located: DataFrame) -> DataFrame:
    """A stage table of what each range emits: its nodes and, behind a conversation's last node,
    the conversation, with offsets that count from the range's start."""
    kind = located.schema["conv_id"].dataType.simpleString()
    schema = (
        f"part int, seq long, kind int, conv_id {kind}, key binary, parent binary, tree binary, depth int, at long, start long, length long, role string, segment string, spans {_SPANS}, path array<binary>"
    )
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        stack: list[Step] = []
        at = seq = 0
        part, seen = None, False

        def path_row(kind: int) -> dict:
            return {"part": part, "seq": seq, "kind": kind, "length": at, "path": [x.key for x in stack], "spans": [{"begin": x.begin, "end": x.end} for x in stack]}

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                part = r["part"]
                shared = _common([x.key for x in stack], r["keys"])
                del stack[shared:]
                for depth in range(shared, len(r["keys"])):
                    above = stack[-1] if stack else None
                    segment = r["segments"][depth]
                    stack.append(_below(above, r["keys"][depth], at, len(segment)))
                    rows.append({
                        "part": part, "seq": seq, "kind": NODE, "key": r["keys"][depth], "parent": above and above.key, "tree": r["keys"][0], "depth": depth, "at": at, "start": above.whole if above else 0,
                        "length": len(segment), "role": r["roles"][depth], "segment": segment, "spans": above.spans if above else [],
                    })
                    at, seq = at + len(segment), seq + 1
                if not seen:
                    rows.append(path_row(FIRST))
                    seen = True
                rows.append({"part": part, "seq": seq, "kind": CONVERSATION, "conv_id": r["conv_id"], "spans": stack[-1].spans})
                seq += 1
            yield pa.RecordBatch.from_pylist(rows, arrow)
        if seen:
            yield pa.RecordBatch.from_pylist([path_row(LAST)], arrow)

    ranged = located.repartitionByRange("keys", "conv_id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("keys", "conv_id")
    return stage_table(ranged.mapInArrow(run, schema), "chat-walk")


def _ranges(walked: DataFrame) -> DataFrame:
    """One row a range: part, dropped (its first nodes' length that an earlier range has emitted),
    base (offset of what follows them) and entry (of those nodes: offsets, and their end in the range).

    The ranges are walked in order, with one path at hand.
    """

    def run(batches):
        stack: list[tuple[bytes, int, int]] = []
        base, dropped, entry = 0, 0, []
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ends = [s["end"] for s in r["spans"]]
                if r["kind"] == FIRST:
                    shared = _common([k for k, _, _ in stack], r["path"])
                    dropped = ends[shared - 1] if shared else 0
                    entry = [{"begin": b, "end": e, "upto": upto} for (_, b, e), upto in zip(stack[:shared], ends)]
                else:
                    told = zip(r["path"], r["spans"])
                    stack = [(k, entry[i]["begin"], entry[i]["end"]) if s["end"] <= dropped else (k, s["begin"] + base - dropped, s["end"] + base - dropped) for i, (k, s) in enumerate(told)]
                    rows.append((r["part"], dropped, base, entry))
                    base += r["length"] - dropped
            spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("upto", pa.int64())]))
            kinds = (pa.int32(), pa.int64(), pa.int64(), spans)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], ["part", "dropped", "base", "entry"])

    bounds = walked.where(F.col("kind") >= FIRST).select("part", "kind", "length", "path", "spans")
    one = bounds.repartition(1).sortWithinPartitions("part", "kind")
    return stage_table(one.mapInArrow(run, "part int, dropped long, base long, entry array<struct<begin:long,end:long,upto:long>>"), "chat-ranges")


def _merged(spans: Column) -> Column:
    """Spans in order, those that touch made one."""

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["begin"].alias("begin"), x["end"].alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] == x["begin"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, F.array().cast(_SPANS), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(add(acc, x)))


def _everywhere(spans: Column) -> Column:
    """Spans of a range as offsets in the whole output: what an earlier range has emitted is where that range put it."""
    used = F.when((F.size(spans) > 0) & (F.get(spans, F.lit(0))["begin"] < F.col("dropped")), F.least(F.get(spans, F.lit(0))["end"], F.col("dropped"))).otherwise(F.lit(0))
    before = F.transform(F.filter("entry", lambda x: x["upto"] <= used), lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end")))
    move = F.col("base") - F.col("dropped")
    own = F.filter(spans, lambda x: x["end"] > F.col("dropped"))
    own = F.transform(own, lambda x: F.struct((F.greatest(x["begin"], F.col("dropped")) + move).alias("begin"), (x["end"] + move).alias("end")))
    return _merged(F.concat(before, own))


def format_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The emitted nodes and the conversations.

    Nodes: key, parent, tree, depth, offset (depth-first, over all trees), start (first
    position id), length, role, segment, loss_begin, loss_end (within the segment), attends
    (united offset intervals of the ancestors), and part and seq, their place in the output.
    Conversations: conv_id, spans (united offset intervals of their nodes), part and seq,
    and in a part's first one entry, the offsets of its nodes that earlier parts emitted.
    """
    walked = _walk(paths(conversations))
    ranges = _ranges(walked)
    few = (ranges.agg(F.sum(F.size("entry") + 1)).first()[0] or 0) <= ENTRIES
    placed = walked.where(F.col("kind") < FIRST).join(F.broadcast(ranges) if few else ranges, "part")
    mask = F.col("role") == LOSS_ROLE
    begin = F.instr("segment", TEXT) - 1 + len(TEXT)
    nodes = placed.where((F.col("kind") == NODE) & (F.col("at") >= F.col("dropped"))).select(
        "key", "parent", "tree", "depth", (F.col("at") + F.col("base") - F.col("dropped")).alias("offset"), "start", "length", "role", "segment",
        F.when(mask, begin).cast("long").alias("loss_begin"), F.when(mask, F.col("length") - len(END)).alias("loss_end"), _everywhere(F.col("spans")).alias("attends"), "part", "seq",
    )
    said = placed.where(F.col("kind") == CONVERSATION)
    first = said.groupBy("part").agg(F.min("seq").alias("first"))
    said = said.join(F.broadcast(first), "part")
    entry = F.when((F.col("seq") == F.col("first")) & (F.size("entry") > 0), F.transform("entry", lambda x: x["begin"]))
    return nodes, said.select("conv_id", _everywhere(F.col("spans")).alias("spans"), "part", "seq", entry.alias("entry"))


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """One row a conversation, from the emitted nodes: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    Each part of the output is read in order, behind the nodes of earlier parts that it
    attends to; a conversation is the nodes of the path at hand that lie in its spans.
    """
    kind = members.schema["conv_id"].dataType.simpleString()
    shown = nodes.select("part", "seq", "depth", "offset", "length", "segment", "loss_begin", "loss_end")
    needed = members.where("entry IS NOT NULL").select(F.col("part").alias("__part"), F.posexplode("entry").alias("__seq", "__offset"))
    context = needed.join(shown, shown["offset"] == needed["__offset"]).withColumns({"part": F.col("__part"), "seq": F.col("__seq") - F.lit(1 << 40)}).select(*shown.columns)
    told = members.select("part", "seq", "conv_id", "spans", F.lit(True).alias("whole"))
    rows = shown.unionByName(context).unionByName(told, allowMissingColumns=True)
    rows = rows.repartition("part").sortWithinPartitions("part", "seq")

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches):
        stack: list[dict] = []
        part = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["part"] != part:
                    part, stack = r["part"], []
                if not r["whole"]:
                    del stack[r["depth"] :]
                    stack.append(r)
                    continue
                spans, mine = iter(r["spans"]), []
                span = next(spans, None)
                for n in stack:
                    while span and span["end"] <= n["offset"]:
                        span = next(spans, None)
                    if span and span["begin"] <= n["offset"] and n["offset"] + n["length"] <= span["end"]:
                        mine.append(n)
                formatted = "".join(n["segment"] for n in mine)
                loss = "".join(unescape(n["segment"][n["loss_begin"] : n["loss_end"]]) for n in mine if n["loss_begin"] is not None)
                turns = TURN_PATTERN.findall(formatted)
                text = "".join(f"{unescape(role)}\n{unescape(said)}\n" for role, said in turns)
                out.append((r["conv_id"], len(turns), sha(text), len(loss), sha(loss), len(formatted)))
            kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@settled("chats")
def round_trip(conversations: DataFrame) -> DataFrame:
    """Formats all conversations and reads them back: one row each."""
    return read_back(*format_tree(conversations))
