"""The line index: cuckoo filters that take and give back keys, counts that follow documents in and out, and the way by a join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytegrain.llm import line_dedup
from bytegrain.llm.line_dedup import CuckooFilter, LineIndex, ShardedFilter

DOCS = "doc_id bigint, text string"


def test_cuckoo_filter_gives_back():
    draw = np.random.default_rng(1)
    keys = draw.integers(0, 2**63, 5000, dtype=np.uint64)
    part = CuckooFilter(len(keys))
    part.insert(keys[:3000])
    before = np.sort(part.table, axis=1).copy()
    part.insert(keys[3000:])
    assert part.contains(keys).all()
    part.delete(keys[3000:])
    assert part.contains(keys[:3000]).all() and part.contains(keys[3000:]).sum() <= 2
    assert np.count_nonzero(part.table) == np.count_nonzero(before) == 3000
    full = CuckooFilter(1)
    with pytest.raises(OverflowError):
        full.insert(keys[:100])


def test_equal_marks_count_each():
    part = CuckooFilter(8)
    same = np.full(3, 77 << 32 | 1, np.uint64)
    part.insert(same)
    part.delete(same[:2])
    assert part.contains(same[:1]).all()
    part.delete(same[:1])
    assert not part.contains(same[:1]).any()


def test_sharded_filter_follows():
    draw = np.random.default_rng(2)
    keys = draw.integers(0, 2**63, 20_000, dtype=np.uint64)
    found = ShardedFilter.of(keys[:9000], 7)
    found.insert(keys[9000:], lambda k: keys[line_dedup.shard_of(keys, 7) == k])
    assert found.taken(keys).all() and sum(found.held) == len(keys)
    found.delete(keys[:9000])
    assert found.taken(keys[9000:]).all() and found.taken(keys[:9000]).mean() < 0.001


def corpus(spark, low, high):
    lines = ["shared by many", " Shared by MANY\t", "in some", "", "  ", "é ü"]
    rows = [(k, "\n".join([lines[k % 2], f"own {k}", lines[2] if k % 5 == 0 else lines[3], lines[4 + k % 2]])) for k in range(low, high)]
    return spark.createDataFrame(rows, DOCS)


def state(index):
    counts = sorted(tuple(r) for r in index.counts.collect())
    frequent = index._keys(index.frequent())
    keys = index._keys(index.counts)
    return counts, sorted(frequent.tolist()), sorted(keys[index.filters.contains(keys)].tolist())


def test_insert_and_delete_equal_a_fresh_build(spark, tmp_path):
    base, more = corpus(spark, 0, 40), corpus(spark, 40, 90)
    index = LineIndex.build(base, min_docs=10, shard_keys=4, removable=True)
    start = state(index)
    grown = index.insert(more)
    assert state(grown) == state(LineIndex.build(base.unionAll(more), min_docs=10))
    assert state(grown)[1] == state(grown)[2] and len(state(grown)[1]) > len(start[1])
    back = grown.delete(more)
    assert state(back) == start == state(index)
    for part, other in zip(back.filters.parts, index.filters.parts):
        assert np.count_nonzero(part.table) == np.count_nonzero(other.table)
    grown.save(f"file://{tmp_path}/index")
    again = LineIndex.load(spark, f"file://{tmp_path}/index")
    assert state(again) == state(grown)
    assert state(again.delete(base).insert(base)) == state(grown)
    kept = line_dedup.drop_lines(more, back.insert(more)).orderBy("doc_id").collect()
    assert kept == line_dedup.drop_lines(more, grown).orderBy("doc_id").collect()


def test_what_was_not_inserted_cannot_be_deleted(spark):
    index = LineIndex.build(corpus(spark, 0, 20), removable=True)
    with pytest.raises(ValueError, match="document 20"):
        index.delete(corpus(spark, 19, 21))
    with pytest.raises(ValueError):
        index.delete(spark.createDataFrame([(3, "another text")], DOCS))
    twice = corpus(spark, 3, 4).unionAll(corpus(spark, 3, 4))
    with pytest.raises(ValueError):
        index.delete(twice)


def test_the_join_way_gives_the_same(spark):
    docs = corpus(spark, 0, 60).unionAll(corpus(spark, 0, 3)).unionAll(spark.createDataFrame([(None, "shared by many\nx"), (70, None), (71, "")], DOCS))
    docs = docs.withColumns({c: F.lit("x") for c in ("_id", "_row", "_frequent", "row", "k1", "n_dropped")})
    ways = [line_dedup.drop_lines(docs, LineIndex.build(docs, filter_keys=n)) for n in (4_000_000, 0)]
    got = [sorted(map(repr, w.collect())) for w in ways]
    assert ways[0].columns == ways[1].columns and got[0] == got[1]
    assert LineIndex.build(docs, filter_keys=0).filters is None
    by_id = {r["doc_id"]: r for r in ways[0].collect()}
    assert by_id[None]["text"] == "x" and by_id[70]["text"] is None and by_id[71]["text"] == "" and by_id[70]["n_lines"] == 1


def test_texts_longer_than_a_slice(spark):
    long = "\n".join(["common"] + [f"line {k} of a long text" for k in range(150_000)])
    docs = spark.createDataFrame([(0, long), *((k, "common\nrare") for k in range(1, 12))], DOCS)
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(docs, LineIndex.build(docs)).collect()}
    assert len(long) > 2 << 20 and got[0]["n_dropped"] == 1 and got[0]["text"] == long[7:] and got[1]["text"] == ""
