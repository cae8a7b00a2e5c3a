"""Spans against brute force, blocks that change nothing, odd tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bytegrain.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(text, items, size):
    words = [(m.start(), m.end(), low(m[0])) for m in WORD.finditer(text or "")]
    hit, named = set(), set()
    for name, item in items:
        own = [low(w) for w in WORD.findall(item or "")]
        for i in range(max(1, len(own) - size + 1) if own else 0):
            window = own[i : i + size]
            for k in range(len(words) - len(window) + 1):
                if [w[2] for w in words[k : k + len(window)]] == window:
                    hit |= set(range(k, k + len(window)))
                    named.add(str(name))
    spans = []
    for k in sorted(hit):
        if spans and k - 1 in hit:
            spans[-1][1] = words[k][1]
        else:
            spans.append([words[k][0], words[k][1]])
    return len(words), len(hit), sorted(named), [tuple(s) for s in spans]


def tables():
    draw = random.Random(6)
    vocabulary = ["ein", "Two", "drei", "é", "日本", "x1", "n0", "six"]
    item = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(k, item(draw.randint(1, 9))) for k in range(40)] + [(40, None), (41, ""), (42, "..."), (43, "Two  drei"), (44, "two,DREI")]
    texts = [draw.choice(["", "— ", "\n"]) + draw.choice([" ", ", ", "\t", "_"]).join(draw.choice(vocabulary).upper() if draw.random() < 0.2 else draw.choice(vocabulary) for _ in range(draw.randint(0, 60))) for _ in range(50)]
    return items, [*enumerate([*texts, None, "", "é" * 10, items[3][1]]), (0, texts[0]), (None, texts[1])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200, 1])
def test_spans_and_blocks(spark, block_bytes):
    items, rows = tables()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("items", "spans", "bucket", "_row")}).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("bucket", F.lit(1))
    got = decontam.contamination(docs, bench, 4, block_bytes).collect()
    want = sorted(repr((i, *brute(t, items, 4))) for i, t in rows)
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), [tuple(s) for s in r["spans"]])) for r in got) == want
    clean = decontam.decontaminated(docs, bench, 4, block_bytes)
    assert clean.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in clean.collect()) == sorted(repr(i) for i, t in rows if not brute(t, items, 4)[1])


def test_held_texts_go_through_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "HELD_BYTES", 1)
    items, rows = tables()
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    sums = [decontam.contamination(docs, bench, 4, b).agg(F.sum("n_hit"), F.sum(F.size("items"))).first() for b in (1 << 20, 300)]
    assert sums[0] == sums[1]


def test_no_items(spark):
    docs, none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert [(r["n_hit"], r["items"], r["spans"]) for r in decontam.contamination(docs, none).collect()] == [(0, [], [])] * 2
    assert decontam.decontaminated(docs, none).count() == 2
