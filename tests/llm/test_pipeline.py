"""The corpus pipeline against brute force in plain Python, and its defined results on odd input."""

import base64
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from bytegrain.llm import simhash

from .test_contracts import DOCS, SF, documents, folder, low, rows_of, words  # noqa: F401

SPACES = " \t\n\x0b\x0c\r"


def shingle_set(text):
    w = words(low(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    """A Jaccard similarity of 0.8 or more; two texts without words are equal."""
    shared = len(a & b)
    return 10 * shared >= 8 * (len(a) + len(b) - shared)


def benchmark_words(text):
    out, word = [], ""
    for c in low(text) + " ":
        if c.isascii() and not (c.isdigit() or c.islower()):
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def components(prints, linked):
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in prints:
            if a < b and linked(prints[a], prints[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in prints}


def test_against_brute_force(spark, folder):  # noqa: F811
    docs = {k: t for k, t in documents(spark, folder).items() if any(map(str.isalpha, t or ""))}
    keys = {k: [low(line.strip(SPACES)) for line in t.split("\n")] for k, t in docs.items()}
    where = defaultdict(set)
    for k, lines in keys.items():
        for key in lines:
            where[key].add(k)
    docs = {k: "\n".join(line for line, key in zip(t.split("\n"), keys[k]) if not key or len(where[key]) < 10) for k, t in docs.items()}
    roots = components({k: shingle_set(t) for k, t in docs.items()}, similar)
    docs = {k: t for k, t in docs.items() if roots[k] == k}
    windows = set()
    for r in rows_of(spark.read.parquet(f"{folder}/benchmark.parquet")):
        w = benchmark_words(r["text"])
        if w:
            windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = benchmark_words(text)
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    docs = {k: t for k, t in docs.items() if clean(t)}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(corpus_pipeline.run(spark, folder))
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        ids = coder.encode_ordinary(docs[r["doc_id"]])
        assert (list(r["ids"]), r["n_tokens"], r["round_trip"]) == (ids, len(ids), True)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_null_ids_repeated_rows_and_clashing_columns(spark, tmp_path):
    """A null doc_id stays; rows that repeat a kept doc_id stay with it; columns of other names are not read."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    one = docs.filter("text rlike '[a-z]{3} [a-z]{3}'").orderBy("doc_id").limit(1)
    odd = one.unionAll(one.withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("text", F.lit("words of its own that no other text here has, so it stays")))
    clash = ("fp", "component_id", "lang_pred", "score", "bucket", "blob", "_kept", "root", "node")
    table = docs.unionAll(odd).select("*", *[F.lit("x").alias(c) for c in clash])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert found.count(None) == 1
    assert len(set(found)) >= len(found) - 1


def forest_components(values, cut, radius):
    """Components of the forest; its links join members of one component, which need not be near themselves."""
    a, b = simhash.forest(values, np.array(cut), radius)
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        assert p != q
        root[max(p, q)] = min(p, q)
    return [find(k) for k in range(len(values))]


@pytest.mark.parametrize("wide", [1, 4])
@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_forest_of_large_groups(wide, step, monkeypatch):
    """Groups of one to hundreds, of near and far fingerprints: components of the forest are those of all pairs."""
    draw = np.random.default_rng(5)
    cut, values = [0], []
    for size in (1, 2, 64, 65, 300, 3):
        seeds = draw.integers(0, 2**63, (max(1, size // 40), wide), dtype=np.uint64)
        rows = seeds[draw.integers(0, len(seeds), size)].copy()
        for row in rows:
            for b in draw.choice(64 * wide, 3 * wide, replace=False):
                row[b // 64] ^= np.uint64(1 << int(b % 64))
        values.append(rows)
        cut.append(cut[-1] + size)
    values = np.concatenate(values)
    original = simhash.forest
    monkeypatch.setattr(simhash, "forest", lambda v, c, r: original(v, c, r, step))
    radius = 5 * wide
    got = forest_components(values, cut, radius)
    for low_, high in zip(cut, cut[1:]):
        prints = {k: sum(int(w) << 64 * i for i, w in enumerate(values[k])) for k in range(low_, high)}
        want = components(prints, lambda a, b: (a ^ b).bit_count() <= radius)
        assert [got[k] for k in range(low_, high)] == [want[k] for k in range(low_, high)]
