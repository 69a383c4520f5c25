import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import prose, table

from gridloom.llm import common, digest_index, ngram_join
from gridloom.llm.components import components


def with_ids(rows):
    return [(d, t) for d, t, *_ in rows if d is not None]


def test_exact_matches_brute_force(docs, rows):
    got = digest_index.deduplicate(docs.where("doc_id IS NOT NULL"))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == brute.exact(with_ids(rows))


def test_exact_null_id_and_empty(docs, empty):
    assert digest_index.deduplicate(docs).count() == docs.count()
    assert digest_index.deduplicate(empty).count() == 0
    assert digest_index.keep_first_copies(empty).columns == empty.columns


def test_exact_longest_then_smallest(spark):
    got = digest_index.deduplicate(table(spark, [(3, "a b", None, None), (2, "a  b", None, None), (1, "ab", None, None), (9, "a  b", None, None)]))
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()} == {(3, 2, 4, False), (2, 2, 4, True), (1, 2, 4, False), (9, 2, 4, False)}


def test_index_keeps_across_batches_and_reopens(spark, tmp_path):
    path = str(tmp_path / "index")
    index = digest_index.DigestIndex(spark, "digest_index_one", path, 2)
    index.ingest(digest_index.digests(table(spark, [(1, "x y", None, None), (2, "z", None, None)])))
    spark.sql("DROP TABLE digest_index_one")
    index = digest_index.DigestIndex(spark, "digest_index_two", path, 2)
    index.ingest(digest_index.digests(table(spark, [(0, "xy", None, None), (5, "new", None, None)])))
    assert sorted(r.keep_id for r in index.table().collect()) == [1, 2, 5]


def test_near_matches_brute_force(docs, rows):
    got = ngram_join.join(docs.where("doc_id IS NOT NULL"))
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())
    assert found == brute.near(with_ids(rows))


def test_near_empty_table_and_null_ids(docs, empty):
    assert ngram_join.join(empty).count() == 0
    one = ngram_join.join(docs.where("doc_id IS NULL")).collect()
    assert [(r.doc_id, r.component_id) for r in one] == [(None, None)]


def test_near_bound_is_exact(spark):
    """9 shared of 11: 0.818; 8 shared of 12: below; 4 of 5: exactly 0.8."""
    a = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"
    rows = [(1, a, None, None), (2, a.rsplit(" ", 1)[0] + " other", None, None), (3, "p q r s t u v w", None, None), (4, "p q r s t u v w x", None, None)]
    rows += [(5, "w0 " + a.rsplit(" ", 2)[0] + " e1 e2 e3", None, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(table(spark, rows)).collect())
    assert got == brute.near([(d, t) for d, t, *_ in rows])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_exact_hot_group(spark):
    """A group larger than the bound for the merge join goes by broadcast."""
    rows = [(i, "same  text" if i == 40 else "same text", None, None) for i in range(150)] + [(i, f"own {i}", None, None) for i in range(150, 200)]
    got = digest_index.deduplicate(table(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute.exact([(d, t) for d, t, *_ in rows])


def test_index_reopened_with_its_own_layout(spark, tmp_path):
    """An index is opened with the buckets it was made with, and refuses others: no digest is appended twice."""
    path = str(tmp_path / "index")
    rows = digest_index.digests(table(spark, [(i, f"text {i}", None, None) for i in range(200)]))
    index = digest_index.DigestIndex(spark, "digest_index_eight", path, 8)
    index.ingest(rows)
    index.drop()
    with pytest.raises(ValueError, match="8 buckets"):
        digest_index.DigestIndex(spark, "digest_index_other", path, 2)
    index = digest_index.DigestIndex(spark, "digest_index_again", path)
    index.ingest(rows)
    assert index.buckets == 8 and index.table().count() == 200
    with pytest.raises(ValueError, match="8 buckets"):
        digest_index.DigestIndex(spark, "digest_index_again", buckets=3)
    index.drop()


def test_index_second_batch_with_a_digest_newly_hot(spark):
    index = digest_index.DigestIndex(spark)
    index.ingest(digest_index.digests(table(spark, [(5, "hot", None, None), (6, "cold", None, None)])))
    again = digest_index.digests(table(spark, [(i, "h o t", None, None) for i in range(100, 400)] + [(9, "cold", None, None), (5, "hot", None, None)]))
    index.ingest(again)
    got = {(r.doc_id, r.keep_id, r.kept) for r in index.resolve(again).collect()}
    index.drop()
    assert got == {(i, 5, False) for i in range(100, 400)} | {(9, 6, False), (5, 5, True)}


def test_first_copies_of_repeated_ids(spark):
    """One row of each text stays, also where one id has several texts or rows."""
    rows = [(1, "a b", "en", "s"), (1, "ab", "en", "s"), (1, "a b", "en", "s"), (2, "ab", None, None), (1, "other", None, None), (None, "x", None, None), (None, "x", None, None)]
    got = digest_index.keep_first_copies(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "a b"), ("1", "other"), ("None", "x")]


def test_no_tables_are_left(spark):
    tables = {t.name for t in spark.catalog.listTables()}
    before = len(common._stages)
    digest_index.deduplicate(table(spark, [(1, "a", None, None)])).collect()
    assert {t.name for t in spark.catalog.listTables()} == tables and len(common._stages) == before + 1


def test_near_common_passage_makes_no_postings(spark, monkeypatch):
    """A passage in many documents that hold enough else is never posted: its rows would grow with the square of its group."""
    rng, posted, posts = random.Random(11), [], ngram_join._postings
    passage = prose(rng, "en", 20)
    rows = [(i, " ".join(f"own{i}x{k}" for k in range(80)) + f" {passage}", None, None) for i in range(200)]
    rows += [(200 + i, f"{t} end", None, None) for i, t, *_ in rows[:20]]
    monkeypatch.setattr(ngram_join, "_postings", lambda *args: posted.append(posts(*args).count()) or posts(*args))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(table(spark, rows)).collect())
    assert got == brute.near([(d, t) for d, t, *_ in rows]) and not sum(posted)


def test_near_drops_heads_before_the_product(docs, monkeypatch):
    """While pairs are made, no table in the shared folder holds more of a row than its first part."""
    made, alive, stage, before = {}, [], ngram_join.stage_table, len(common._stages)

    def spy(df, name):
        out = stage(df, name)
        made[common._stages[-1]] = out.columns
        if name == "near":
            alive.append([made[path] for path in common._stages[before:]])
        return out

    monkeypatch.setattr(ngram_join, "stage_table", spy)
    ngram_join.join(docs.where("doc_id IS NOT NULL"))
    assert alive and not any({"head", "text"} & set(columns) for tables in alive for columns in tables)


def test_near_any_late_columns_give_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 8)
    got = ngram_join.join(docs.where("doc_id IS NOT NULL"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute.near(with_ids(rows))


def test_near_first_parts_without_late_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, n, sorted(rng.choice(400, min(n, n // 5 + 1 + n // 10 + 8), replace=False).tolist())) for i, n in enumerate(rng.integers(1, 120, 3 * common.SLICE).tolist())]
    late = set(range(0, 400, 3))
    found = ngram_join.sketch(spark.createDataFrame([(t,) for t in late], "t long"))
    late = set(np.arange(400)[ngram_join._may_hold(found.value, np.arange(400))].tolist())
    got = ngram_join._first_parts(spark.createDataFrame(rows, "rep long, n long, head array<long>").coalesce(1), found).collect()
    want = {i: (n, [t for t in head if t not in late]) for i, n, head in rows}
    assert {r.rep: (r.n, r.own) for r in got} == {i: (n, cold[: n // 5 + 1] if len(cold) > n // 5 else None) for i, (n, cold) in want.items()}
    assert any(r.own is None for r in got) and any(r.own for r in got)


def test_stage_tables_are_made_in_small_batches(spark):
    """A task of a stage table holds SLICE rows in Python at most; the session's own setting stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["rows"])

    got = [r.rows for r in common.stage_table(spark.range(0, 5 * common.SLICE, 1, 1).mapInArrow(sizes, "rows long"), "sizes").collect()]
    assert sum(got) == 5 * common.SLICE and max(got) == common.SLICE and spark.conf.get(setting) == before
