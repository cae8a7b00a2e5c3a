"""The ten queries against brute force in plain Python, over small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
import xxhash

from bytegrain.llm import queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


LINES = ["a common line here", "  A COMMON line here\t", "", "   ", "Größe é ñ", "x" * 50]
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [None, "", "   ", "\n\n", "...", "a", "A b", "12 34", "same same same " * 40, "y" * 5000, PASSAGE, PASSAGE.upper(), f"start {PASSAGE} end", "\n".join(LINES * 3), "é ü ß " * 30, "word\x0bword\x0cword\rword\u00a0word", "#*$ " * 60, rows[0]["text"], rows[0]["text"] + " tail", "z " * 20000]
    odd += ["\n".join([LINES[k % 2], f"own {k}", LINES[4]]) for k in range(12)]
    rows += [{"doc_id": 100_000 + k, "text": t, "lang": None if k % 3 else "en", "source": "odd", "n_chars": len(t or "")} for k, t in enumerate(odd)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [r.asDict() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [{"item_id": 900, "text": None}, {"item_id": 901, "text": ""}, {"item_id": 902, "text": PASSAGE}, {"item_id": 903, "text": "Größe é"}, {"item_id": 904, "text": PASSAGE}]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [r.asDict() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.net/en/x", "http://net/", "http://a.net", "http://xnet/", "http://www.example.com/de/a?b", "ftp://x.org/fr/", "http://x.org/FR/", "http://a.spam-farm.example.org/zz/", "a://b.net/c://d.org/fr/", "http://example.net/en\n/", "//x://y.net/#"]
    pages += [{"page_id": 5000 + k, "url": u, "html": None if k % 4 == 0 else "" if k % 4 == 1 else "<p>same</p>" if k % 4 == 2 else f"<p>{k} é</p>"} for k, u in enumerate(urls)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


def documents(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    frame = queries.QUERIES[name](spark, folder)
    other = con.execute(queries.ORACLES[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(map(repr, other.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in frame.collect()) == want


def test_url_filter(spark, folder):
    got = {r["page_id"]: r for r in rows_of(queries.op1_url_filter(spark, folder))}
    urls = {r["page_id"]: r["url"] for r in rows_of(spark.read.parquet(f"{folder}/pages.parquet"))}
    assert got.keys() == urls.keys()
    for k, url in urls.items():
        host = path = ""
        if url and "://" in url:
            m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
            host, path = low(m[1]), m[2]
        fits = [r for r in queries.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        blocked = any(host == h or host.endswith("." + h) for h in queries.BLOCKED)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule and rule.text)
        assert got[k]["verdict"] == (rule.verdict if rule else "block" if blocked else "allow")


def test_warc(spark, folder):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in rows_of(spark.read.parquet(f"{folder}/pages.parquet"))}
    top = {}
    for k, p in pages.items():
        top[p] = max(top.get(p, k), k)
    got = rows_of(queries.op4_warc(spark, folder))
    assert len(got) == len(pages)
    for r in got:
        p = pages[r["page_id"]]
        first = top[p] == r["page_id"]
        assert r == {"page_id": r["page_id"], "payload_bytes": len(p), "payload_digest": base64.b32encode(hashlib.sha1(p).digest()).decode(), "record_type": "response" if first else "revisit", "refers_to": None if first else top[p]}


def brute_fingerprint(text, size):
    w = words(low(text))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, folder):
    docs = documents(spark, folder)
    prints = {k: brute_fingerprint(t, 3) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(queries.op5_simhash(spark, folder))}
    assert got == {k: (f"{prints[k]:016x}", find(k)) for k in docs}


def test_language_id(spark, folder):
    source = {r["doc_id"]: r for r in rows_of(spark.read.parquet(f"{folder}/documents.parquet"))}
    got = rows_of(queries.op6_language_id(spark, folder))
    assert {r["doc_id"] for r in got} == source.keys()
    right = known = 0
    for r in got:
        text = source[r["doc_id"]]["text"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
        if r["held_out"] and source[r["doc_id"]]["source"] != "odd":
            known += 1
            right += r["lang_pred"] == source[r["doc_id"]]["lang"]
    assert right >= 0.95 * known


def test_byte_bpe(spark, folder):
    with open(public_tokenizers.path(queries.TOKENS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, folder)
    got = rows_of(queries.op9_byte_bpe(spark, folder))
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]] or ""
        ids = coder.encode_ordinary(text)
        assert r == {"doc_id": r["doc_id"], "n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids))), "decoded_sha256": sha(text)}


def test_lm_scoring(spark, folder):
    docs = documents(spark, folder)
    tokens = {k: [*words(low(t)), None] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    counts = Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(counts.values()), len(counts)
    got = rows_of(queries.op10_lm_scoring(spark, folder))
    assert {r["doc_id"] for r in got} == docs.keys() and len(got) == len(docs)
    sums = {}
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(w in counts for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r["score"] < 0
        kind = "held out" if r["held_out"] else "trained on"
        if r["n_known"] == r["n_tokens"]:  # add-one gives every unknown word the share of one, however many there are
            sums[kind] = [x + r[c] for x, c in zip(sums.get(kind, (0, 0)), ("base_score", "score"))]
    print("log10 probabilities, add-one and model:", sums)
    assert len(sums) == 2 and all(model > base for base, model in sums.values())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table, schema in (("documents", DOCS), ("benchmark", "item_id bigint, text string"), ("pages", "page_id bigint, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_whole_tables_are_read():
    """No query of this folder cuts its table: none of the words for that is in it."""
    text = open(os.path.join(os.path.dirname(queries.__file__), "queries.py")).read()
    assert not re.search(r"\.limit\(|\.sample\(|\.head\(|\.take\(", text)
