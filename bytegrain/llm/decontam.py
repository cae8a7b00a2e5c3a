"""Benchmark decontamination by one Aho-Corasick automaton over the normalised windows of all items.

Texts are read once. A benchmark that is too large for one automaton is cut into blocks of items, which lie in the shared folder; a task then
holds some of its texts and scans them by one block's automaton after another, so neither the driver nor a task ever holds all items.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import dealt, mapped, shared_folder
from .text import LOWER, buffer, byte_set, covered, slices, spans

#: Bytes outside words; words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
BREAK = byte_set(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by single spaces, with a space before and after each document and a line break between; then for each place in
    it its place in the original bytes, and the words' spans (starts, first of each document) in the original."""
    low = LOWER[data]
    starts, ends, first = spans(low, offsets, BREAK)
    n = len(low)
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    flags = np.cumsum(edge[:-1]) > 0
    # a space ends every word, and each document begins with line break and space
    sizes = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1] + 2 * (np.searchsorted(first, np.arange(len(starts)), "right"))
    out = np.full(int(sizes.sum()) + 2 * (len(offsets) - 1), 32, np.uint8)
    heads = np.concatenate([[0], np.cumsum(sizes)])[first[:-1]] + 2 * np.arange(len(offsets) - 1)
    out[heads] = 10
    places = np.flatnonzero(flags)
    where = np.repeat(at - np.concatenate([[0], np.cumsum(sizes - 1)])[:-1], sizes - 1) + np.arange(len(places))
    out[where] = low[places]
    return out, at, starts, first


def windows(text: str | None, size: int) -> list[str]:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if text else []
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Scanner:
    """An automaton over windows, and the items of each."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        self.items: dict[str, set] = defaultdict(set)
        for name, text in items:
            for w in windows(text, size):
                self.items[w].add(name)
        self.automaton = ahocorasick.Automaton()
        self.windows = sorted(self.items)
        for k, w in enumerate(self.windows):
            self.automaton.add_word(f" {w} ".encode().decode("latin-1"), (k, len(w.encode()) + 1, w.count(" ") + 1))
        if self.windows:
            self.automaton.make_automaton()

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First words and numbers of words of all occurrences, and their windows; the words' starts and each document's first word."""
        text, at, starts, first = normalised(data, offsets)
        if not self.windows:
            return (np.zeros(0, np.int64),) * 3 + (starts, first)
        hits = [(end - back, n, k) for end, (k, back, n) in self.automaton.iter(text.tobytes().decode("latin-1"))]
        if not hits:
            return (np.zeros(0, np.int64),) * 3 + (starts, first)
        begin, n, k = np.array(hits, np.int64).T
        return np.searchsorted(at, begin), n, k, starts, first


#: Bytes of items in an automaton, whose nodes take some hundred times as much, and of texts that a task holds while it changes automata.
BLOCK_BYTES, HELD_BYTES = 1 << 20, 64 << 20


class Blocks:
    """The items in blocks, written to the shared folder: for tasks, which read them one at a time. One block alone stays as it is built."""

    _kept: dict[str, Scanner] = {}

    def __init__(self, benchmark: DataFrame, size: int, block_bytes: int):
        known = benchmark.select("item_id", "text").filter("text is not null")
        total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.number, self.size, self.path = max(1, -(-total // block_bytes)), size, shared_folder(benchmark.sparkSession)
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(self.number)).cast("int")
        by_block = known.select(block.alias("bucket"), F.col("item_id").cast("string").alias("item_id"), "text")
        dealt(by_block, self.number).write.partitionBy("bucket").parquet(self.path)

    def scanner(self, k: int) -> Scanner:
        name = f"{self.path}/{k}"
        if name not in self._kept:
            store, root = pafs.FileSystem.from_uri(self.path)
            found = store.get_file_info(pafs.FileSelector(f"{root}/bucket={k}", allow_not_found=True))
            rows = [r for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".parquet") for r in pq.read_table(store.open_input_file(f.path), columns=["item_id", "text"]).to_pylist()]
            self._kept.clear()
            self._kept[name] = Scanner([(r["item_id"], r["text"]) for r in rows], self.size)
        return self._kept[name]

    def scanned(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        """Each piece of texts with what every block's automaton finds in it (that, and the automaton)."""
        held: list[pa.RecordBatch] = []
        for piece in (p for batch in batches for p in slices(batch, "text", 1 << 20)):
            held.append(piece)
            if self.number == 1 or sum(p.nbytes for p in held) >= HELD_BYTES:
                yield from self._through(held)
                held = []
        yield from self._through(held)

    def _through(self, held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        found: list[list[tuple]] = [[] for _ in held]
        for k in range(self.number if held else 0):
            scanner = self.scanner(k)
            for piece, own in zip(held, found):
                begin, n, which, starts, first = scanner.scan(*buffer(piece.column("text")))
                owner = np.searchsorted(first, begin, "right") - 1
                items = {(d, i) for d, w in set(zip(owner.tolist(), which.tolist())) for i in scanner.items[scanner.windows[w]]}
                own.append((begin, n, items, len(starts), first))
        yield from zip(held, found)


RESULT = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted) and spans (code points of the original text: the runs of words that windows cover).

    block_bytes: benchmark text of one automaton; the result does not depend on it. Null texts have no words; an empty benchmark finds
    nothing; items with equal windows are all named; items without words are never found; repeated documents give repeated rows, an empty
    table an empty one. Other columns of either table are not read.
    """
    blocks = Blocks(benchmark, size, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, found in blocks.scanned(batches):
            n, first = found[0][3:]
            hit = covered(n, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
            n_hit = np.concatenate([[0], np.cumsum(hit)])
            n_hit = n_hit[first[1:]] - n_hit[first[:-1]]
            items: list[list[str]] = [[] for _ in range(piece.num_rows)]
            for d, i in sorted(set().union(*(f[2] for f in found))):
                items[d].append(i)
            spans = [_places(piece.column("text")[d].as_py(), hit[first[d] : first[d + 1]]) if n_hit[d] else [] for d in range(piece.num_rows)]
            columns = [piece.column("doc_id"), pa.array(np.diff(first)), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return docs.select("doc_id", "text").transform(mapped, run, RESULT)


def _places(text: str, hit: np.ndarray) -> list[dict]:
    """Code points of runs of hit words in the original text."""
    out: list[dict] = []
    before = False
    for word, h in zip(WORD.finditer(text), hit):
        if h and before:
            out[-1]["end"] = word.end()
        elif h:
            out.append({"start": word.start(), "end": word.end()})
        before = bool(h)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns, whatever their names; no shuffle.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark keeps all, an empty table is empty.
    """
    blocks = Blocks(benchmark, size, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, found in blocks.scanned(batches):
            clean = np.ones(piece.num_rows, bool)
            for begin, _, _, _, first in found:
                clean[np.searchsorted(first, begin, "right") - 1] = False
            yield piece.filter(pa.array(clean))

    return docs.transform(mapped, run, docs.schema)
