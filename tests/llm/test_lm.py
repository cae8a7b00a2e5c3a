"""The Pitman-Yor model against a sampler that moves one customer at a time, and as a distribution."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytegrain.llm import lm
from bytegrain.llm.exchange import width


def fitted(spark, texts, **settings):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("held", F.lit(False)).withColumn("row", F.monotonically_increasing_id())
    hot = lm.hot_words(docs)
    table = lm.cells(lm.asked(docs, width(spark), hot), width(spark)).collect()
    model = lm.fit(spark.createDataFrame(table, lm._ASKED), hot, **settings)
    return model, [lm.Cell(bytes(r["blob"]), model) for r in table if r["kind"] == 0]


def words_of(x):
    return [bytes(x.data[a:b]).decode() for a, b in zip(x.starts.tolist(), x.ends.tolist())]


@pytest.mark.parametrize("customers, a, discount", [(1, 3.0, 0.5), (20, 0.5, 0.5), (40, 5.0, 0.8), (400, 30.0, 0.3), (3000, 2.0, 0.7)])
def test_seat_is_the_process(customers, a, discount):
    draw = np.random.default_rng(1)
    got = lm.seat(np.full(400, customers), np.full(400, a), discount, draw)
    exact = []
    for _ in range(400):
        tables = 1
        for i in range(1, customers):
            tables += draw.random() < a / (a + i - discount * tables)
        exact.append(tables)
    assert got.min() >= 1 and got.max() <= customers
    assert abs(got.mean() - np.mean(exact)) <= 4 * np.sqrt((got.var() + np.var(exact)) / 400) + 0.03 * np.mean(exact)


def one_by_one(tokens, base, discounts, strength, sweeps, burn_in, seed):
    """A Gibbs sampler over two levels that takes every customer from its table and seats it again; averaged probabilities of (context, word)."""
    draw = np.random.default_rng(seed)
    tables = {"low": defaultdict(list), "top": defaultdict(list)}  # of (restaurant, dish): customers of each table
    customers, total = {"low": defaultdict(int), "top": defaultdict(int)}, {"low": defaultdict(int), "top": defaultdict(int)}

    def p(level, r, w):
        up = base[w] if level == "top" else p("top", 0, w)
        own = tables[level][r, w]
        d = discounts[level]
        return (sum(own) - d * len(own) + (strength + d * total[level][r]) * up) / (strength + customers[level][r])

    def add(level, r, w):
        up = base[w] if level == "top" else p("top", 0, w)
        own, d = tables[level][r, w], discounts[level]
        weights = np.array([n - d for n in own] + [(strength + d * total[level][r]) * up])
        k = draw.choice(len(weights), p=weights / weights.sum())
        customers[level][r] += 1
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            total[level][r] += 1
            if level == "low":
                add("top", 0, w)

    def remove(level, r, w):
        own = tables[level][r, w]
        k = draw.choice(len(own), p=np.array(own) / sum(own))
        own[k] -= 1
        customers[level][r] -= 1
        if not own[k]:
            own.pop(k)
            total[level][r] -= 1
            if level == "low":
                remove("top", 0, w)

    for r, w in tokens:
        add("low", r, w)
    out = defaultdict(float)
    for sweep in range(sweeps):
        for r, w in tokens:
            remove("low", r, w)
            add("low", r, w)
        if sweep >= burn_in:
            for r, w in set(tokens):
                out[r, w] += p("low", r, w) / (sweeps - burn_in)
    return out


def test_against_one_customer_at_a_time(spark):
    draw = np.random.default_rng(2)
    vocabulary, texts = ["ab", "ac", "b", "cd", "e"], []
    for _ in range(12):
        at, out = 0, []
        for _ in range(8):
            at = int(draw.choice(5, p=np.roll([0.6, 0.2, 0.1, 0.05, 0.05], at)))
            out.append(vocabulary[at])
        texts.append(" ".join(out))
    model, cells = fitted(spark, texts, burn_in=8, samples=24)
    tokens, base, got = [], {}, {}
    for x in cells:
        names, own, p = words_of(x), x.spelled(model.spellings[-1]), lm.predictive(x)
        for w, k, c, y in zip(x.w.tolist(), x.k.tolist(), x.c.tolist(), p.tolist()):
            tokens += [(k, names[w])] * c
            base[names[w]] = 1e-4 if x.hot[w] >= 0 else own[w]
            got[k, names[w]] = y
    want = one_by_one(tokens, base, {"low": model.discount, "top": model.word_discount}, model.strength, 120, 20, 3)
    assert got.keys() == want.keys() and model.tokens == len(tokens)
    gaps = [abs(got[k] - want[k]) for k in got]
    assert max(gaps) < 0.12 and np.mean(gaps) < 0.03


def test_probabilities_add_up(spark):
    """In each context those of known words and what is left for all others make one, and spellings of all words do."""
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in draw.zipf(1.5, 60) % 800) for _ in range(40)]
    model, cells = fitted(spark, texts, burn_in=1, samples=1)
    t = model.sweeps[-1]
    seated, pairs = np.zeros(lm.CONTEXTS), np.zeros(lm.CONTEXTS)
    for x in cells:
        *_, (pair, _, _, _) = x.replay(len(model.sweeps) - 1)
        seated += np.bincount(x.k, pair, lm.CONTEXTS)
        pairs += np.bincount(x.k, x.c - model.discount * pair, lm.CONTEXTS)
    assert np.allclose(seated, t.context_tables)
    used = model.context_customers > 0
    assert np.allclose((pairs + model.strength + model.discount * t.context_tables)[used], (model.context_customers + model.strength)[used])
    rows = 10.0 ** model.spellings[-1].astype(np.float64).reshape(-1, 256)
    assert np.abs(rows.sum(1) - 1).max() < 0.02


def test_runs_agree_and_doubles_are_likelier(spark):
    draw = np.random.default_rng(7)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in range(150)]
    texts = [" ".join(words[int(x)] for x in draw.integers(0, 600, 120)) for _ in range(60)]
    texts += texts[:20]  # twice in the corpus
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, F.lit(False)).collect()}
    again = {r["doc_id"]: r["score"] for r in lm.score(docs.repartition(1).sortWithinPartitions("doc_id"), F.lit(False)).collect()}
    assert got.keys() == again.keys() and all(abs(got[k] - again[k]) < 0.05 * abs(got[k]) for k in got)
    twice, once = [got[k] for k in (*range(20), *range(60, 80))], [got[k] for k in range(20, 60)]
    assert min(twice) > max(once)


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "a b a", "x"), (1, None, "y"), (1, "", "y"), (2, "a b a", "z"), (2, "a b a", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, held string").withColumns({c: F.lit(1) for c in ("row", "bucket", "kind", "blob", "base")})
    got = lm.score(docs, F.lit(False)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in got) == [(0, 4, 4), (1, 1, 1), (1, 1, 1), (2, 4, 4), (2, 4, 4)]
    assert all(r["score"] < 0 and r["train_tokens"] == 14 and r["vocabulary"] == 3 for r in got)
