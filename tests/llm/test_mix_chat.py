import brute
import pytest

from gridloom.llm import chat_tree, source_mix
from gridloom.llm.queries import HOSTILE


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5, 0], [0, 0], [100, 1, 1, 1, 400, 9], [7]])
def test_targets(sizes):
    weights = [float(1 + i % 3) for i in range(len(sizes))]
    got = source_mix.targets(sizes, weights)
    assert got == pytest.approx(brute.targets(sizes, weights)) and sum(got) == pytest.approx(sum(sizes))


def test_mix_comes_near_its_targets(docs, rows, empty):
    got = source_mix.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, map(str, got))) == sorted(map(tuple, map(str, source_mix.mix(docs).collect())))
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source_size, [0, r.target, 0])
        by[r.source_size][0] += r["size"]
        by[r.source_size][2] += r.taken
    for size, (total, target, taken) in by.items():
        assert total == size and abs(taken - target) <= 0.05 * target + 64
    assert source_mix.mix(empty).count() == 0 and source_mix.mixed_documents(empty).columns == empty.columns


@pytest.mark.parametrize("case", ["even", "small sources", "nulls and repeated rows"])
def test_mix_walked_slot_by_slot(spark, case):
    """Each document's words against the schedule walked in plain Python, and each source's against its target."""
    if case == "even":
        rows = [(i, "ab"[i % 2], i % 40) for i in range(60)]
    elif case == "small sources":
        rows = [(i, "big", 60) for i in range(500)] + [(1000, "mid", 17), (1001, "small", 5), (1002, "none", 0)]
    else:
        rows = [(None, None, 9)] * 3 + [(7, "a", 4), (7, "a", 4), (7, "a", 900), (7, "b", 3), (8, None, 50)]
    docs = spark.createDataFrame([(d, "w " * n, s) for d, s, n in rows], "doc_id long, text string, source string")
    got = source_mix.mix(docs).collect()
    want = brute.mix(rows, source_mix.block_words(sum(n for _, _, n in rows)), source_mix.LEAST_BLOCKS)
    assert sorted((str(r.doc_id), r["size"], r.taken) for r in got) == sorted((str(d), n, t) for (d, _, n), t in zip(rows, want))
    for size, target in {(r.source_size, r.target) for r in got}:
        taken = sum(r.taken for r in got if (r.source_size, r.target) == (size, target))
        assert abs(taken - target) <= max(1, 0.01 * size)
    times = source_mix.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert all(r["count"] <= 3 * sum(d == r.doc_id for d, _, _ in rows) for r in times)


def test_schedule_spreads_sources(spark):
    """Ranks count a source's slots in order, and every run of slots has each source close to its share."""
    sized = spark.createDataFrame([(i, "abc"[i % 3], 400, i) for i in range(300)], "doc_id long, source string, size long, row long")
    slots = [r.src for r in source_mix.schedule(source_mix.sources(sized)).orderBy("slot").collect()]
    ranks = [(r.src, r["rank"]) for r in source_mix.schedule(source_mix.sources(sized)).orderBy("slot").collect()]
    assert all(sorted(k for s, k in ranks if s == src) == [k for s, k in ranks if s == src] == list(range(slots.count(src))) for src in range(3))
    for at in range(0, len(slots) - 64, 64):
        for src in range(3):
            assert abs(slots[at : at + 64].count(src) / 64 - slots.count(src) / len(slots)) < 0.1


def chats(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (2, 0, "system", "s"), (2, 1, "user", "hi"), (2, 2, "assistant", "no"), (2, 3, "user", None)]
    rows += [(3, 0, "system", "s"), (4, 1, "user", HOSTILE), (4, 0, None, "\\<|end|>\\"), (4, 2, "assistant", HOSTILE + "\\"), (5, None, "assistant", ""), (5, 3, "assistant", "é\n😀")]
    rows += [(6, 0, "user", "x"), (6, 0, "user", "x"), (None, 0, "user", "<<SYS>>x<</SYS>>[INST][/INST]<s><|text|>")]
    rows += [(7, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(60)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")


def test_chat_reads_back(spark):
    rows, frame = chats(spark)
    got = {r.conv_id: tuple(r)[1:5] for r in chat_tree.read_back(*chat_tree.format_tree(frame)).collect()}
    want = {c: brute.conversation([(-1 if t is None else t, r, x) for k, t, r, x in rows if k == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_chat_tree_shape(spark):
    _, frame = chats(spark)
    nodes, members = chat_tree.format_tree(frame)
    nodes = {r.key: r for r in nodes.collect()}
    # A shared turn is one node, the emitted segments tile the output, a parent comes before its child.
    assert sum(n.role == "system" for n in nodes.values()) == 1
    at = 0
    for n in sorted(nodes.values(), key=lambda n: n.offset):
        assert n.offset == at
        at += n.length
        chain, p = [], n.parent
        while p:
            chain.append(nodes[p])
            p = nodes[p].parent
        assert len(chain) == n.depth and n.start == sum(c.length for c in chain)
        assert all(c.offset < n.offset for c in chain)
        covered = sorted(x for c in chain for x in range(c.offset, c.offset + c.length))
        assert covered == [x for i in n.attends for x in range(i.begin, i.end)]
        if n.role == "assistant":
            assert n.segment[n.loss_end :] == chat_tree.END and n.segment[: n.loss_begin].endswith(chat_tree.TEXT)


def test_chat_shared_over_ranges(spark):
    """A first turn that all share, and a conversation that a third repeat, over many small ranges: nothing
    is emitted twice, and each conversation reads back."""
    rows = [(i, 0, "system", "the same for all") for i in range(300)]
    rows += [(i, 1, "user", "again" if i % 3 == 0 else f"ask {i % 7}") for i in range(300)]
    rows += [(i, 2, "assistant", "yes" if i % 3 == 0 else f"say {i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        nodes, members = chat_tree.format_tree(frame)
        nodes, members = nodes.cache(), members.cache()
        assert nodes.select("part").distinct().count() > 8 and members.where("entry IS NOT NULL").count() > 8
        found = sorted(nodes.collect(), key=lambda n: n.offset)
        got = {r.conv_id: tuple(r)[1:5] for r in chat_tree.read_back(nodes, members).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    paths = {tuple(t for c, _, _, t in sorted(rows) if c == i)[:k] for i in range(300) for k in (1, 2, 3)}
    assert len(found) == len({bytes(n.key) for n in found}) == len(paths)
    assert [n.offset for n in found] == [sum(m.length for m in found[:k]) for k in range(len(found))]
    by = {bytes(n.key): n for n in found}
    for n in found:
        chain, p = [], n.parent
        while p:
            chain.append(by[bytes(p)])
            p = by[bytes(p)].parent
        assert sorted(x for c in chain for x in range(c.offset, c.offset + c.length)) == [x for i in n.attends for x in range(i.begin, i.end)]
    assert got == {i: brute.conversation([(t, r, x) for c, t, r, x in rows if c == i]) for i in range(300)}


def test_chat_empty(spark):
    _, frame = chats(spark)
    assert chat_tree.read_back(*chat_tree.format_tree(frame.limit(0))).count() == 0
