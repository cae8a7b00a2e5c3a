"""Quality rules as a short-circuit cascade: the cheapest rejections come first.

What rules measure is made on first use, for the documents that are still in question, and shared by the rules after it.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import mapped
from .text import SLICE_BYTES, SPACE, buffer, byte_set, covered, lines, mixed, owners, slices, span_hashes, spans, sums_by

SYMBOLS = byte_set(b"#*$%&|<>")
U64 = np.uint64


class Slice:
    """A slice of documents and what rules measure on it; each measure is made once, on first use."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n, self.made = data, offsets, len(offsets) - 1, {}

    def __getattr__(self, name: str):
        if name in ("data", "offsets", "n", "made") or name.startswith("__"):
            raise AttributeError(name)
        if name not in self.made:
            self.made[name] = getattr(type(self), f"get_{name}")(self)
        return self.made[name]

    def per_byte(self, flags: np.ndarray) -> np.ndarray:
        return sums_by(flags, self.offsets)

    def get_words(self):
        return spans(self.data, self.offsets, SPACE)

    def get_lines(self):
        return lines(self.data, self.offsets)

    def get_n_words(self):
        return np.diff(self.words[2])

    def get_word_chars(self):
        return self.per_byte(~SPACE[self.data] & ((self.data & 0xC0) != 0x80))

    def get_n_symbols(self):
        return self.per_byte(SYMBOLS[self.data])

    def get_word_hashes(self):
        return span_hashes(self.data, *self.words[:2])

    def get_n_dup_lines(self):
        starts, ends, first = self.lines
        has_word = self.words[0].searchsorted(starts) < self.words[1].searchsorted(ends, "right")
        at = np.flatnonzero(has_word)
        owner = owners(first)[at]
        key = mixed(span_hashes(self.data, starts[at], ends[at]) + owner.astype(U64))
        again = np.ones(len(at), bool)
        again[np.unique(key, return_index=True)[1]] = False
        return np.bincount(owner[again], minlength=self.n)

    def get_n_repeat_words(self):
        first, h = self.words[2], self.word_hashes
        if len(h) < 3:
            return np.zeros(self.n, np.int64)
        owner = owners(first)
        whole = np.flatnonzero(owner[:-2] == owner[2:])
        key = mixed(h[whole] + U64(3) * mixed(h[whole + 1]) + owner[whole].astype(U64))
        key = mixed(key + h[whole + 2])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        return sums_by(covered(len(h), whole[twice], 3), first)

    def get_n_lines(self):
        return np.diff(self.lines[2])

    def get_short_lines(self):
        starts, ends, first = self.lines
        return sums_by(ends - starts < 1, first)

    def get_letters(self):
        """ASCII letters and all other characters beyond ASCII."""
        low = self.data | 32
        return self.per_byte(((low >= 97) & (low <= 122)) | (self.data >= 0xC0))


@dataclass(frozen=True)
class Rule:
    """A name, and which documents of a slice it rejects."""

    name: str
    rejects: Callable[[Slice], np.ndarray]


#: Wide limits: text in any language passes, runs of symbols, tables of bars and looping text do not.
RULES = (
    Rule("mean_word_length", lambda s: (s.word_chars < 2 * s.n_words) | (s.word_chars > 14 * s.n_words)),
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("letters", lambda s: 2 * s.letters < s.word_chars),
    Rule("duplicate_lines", lambda s: 10 * s.n_dup_lines > 3 * s.n_lines),
    Rule("empty_lines", lambda s: 10 * s.short_lines > 8 * s.n_lines),
)


#: The base rules; what they measure is part of the results where `measures` are asked for.
BASE = (
    Rule("few_words", lambda s: s.n_words < 50),
    Rule("repeated_words", lambda s: 100 * s.n_repeat_words > 50 * s.n_words),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(s: Slice) -> np.ndarray:
    return BASE[0].rejects(s) | BASE[1].rejects(s)


class Timed(Slice):
    """A slice that notes the seconds that each measure takes by itself, and which measures are asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets)
        self.made["_seconds"], self.made["_asked"], self.made["_inner"] = {}, set(), [0.0]

    def __getattr__(self, name: str):
        if name.startswith("_"):
            if name in self.made:
                return self.made[name]
            raise AttributeError(name)
        if name in ("data", "offsets", "n", "made"):
            raise AttributeError(name)
        self._asked.add(name)
        if name not in self.made:
            self._inner.append(0.0)
            began = time.perf_counter()
            self.made[name] = getattr(type(self), f"get_{name}")(self)
            took = time.perf_counter() - began
            self._seconds[name] = self._seconds.get(name, 0.0) + took - self._inner.pop()
            self._inner[-1] += took
        return self.made[name]


_STATS = "kind string, name string, part string, seconds double, n bigint"


def sampled(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int, after: tuple[Rule, ...]) -> list:
    """What rules and their measures cost and reject on a sample of about sample_rows rows, chosen by a hash of id and text and measured
    where they lie; only sums come back. after: rules that documents of the sample must have passed."""
    n = docs.count()
    chance = F.pmod(F.xxhash64(F.lit("quality"), "doc_id", "text"), F.lit(1 << 20)) < F.lit(min(1 << 20, math.ceil(sample_rows / max(1, n) * (1 << 20))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                s = Slice(*buffer(piece.column("text")))
                passed = ~np.logical_or.reduce([x.rejects(s) for x in after]) if after else np.ones(s.n, bool)
                part = _thinned(s, passed)
                if not part.n:
                    continue
                t = Timed(part.data, part.offsets)
                t.made |= part.made
                for rule in rules:
                    t._asked.clear()
                    began, inner = time.perf_counter(), t._inner[-1]
                    rejected = int(np.count_nonzero(rule.rejects(t)))
                    own = time.perf_counter() - began - (t._inner[-1] - inner)
                    rows += [("rule", rule.name, "", own, rejected), *(("uses", rule.name, m, 0.0, 0) for m in sorted(t._asked))]
                rows += [("measure", "", m, v, 0) for m, v in t._seconds.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 5, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()))], ["kind", "name", "part", "seconds", "n"])

    return docs.select("doc_id", "text").filter(chance).select("text").transform(mapped, run, _STATS).groupBy("kind", "name", "part").agg(F.sum("seconds").alias("seconds"), F.sum("n").alias("n")).collect()


def ordered(rules: tuple[Rule, ...], stats: list) -> list[Rule]:
    """Rules by rejections per second, highest first, where a measure that an earlier rule has made costs nothing; ties keep their order.

    The order changes the time only: a document is kept if no rule rejects it.
    """
    rejected = {r["name"]: r["n"] for r in stats if r["kind"] == "rule"}
    own = {r["name"]: r["seconds"] for r in stats if r["kind"] == "rule"}
    cost = {r["part"]: r["seconds"] for r in stats if r["kind"] == "measure"}
    uses: dict[str, set] = {}
    for r in stats:
        if r["kind"] == "uses":
            uses.setdefault(r["name"], set()).add(r["part"])
    made: set = set()
    out, left = [], list(rules)
    while left:
        rate = [rejected.get(x.name, 0) / max(1e-9, own.get(x.name, 0.0) + sum(cost.get(m, 0.0) for m in uses.get(x.name, set()) - made)) for x in left]
        best = left.pop(rate.index(max(rate)))
        made |= uses.get(best.name, set())
        out.append(best)
    return out


def cascade(part: Slice, rules: list[Rule]) -> np.ndarray:
    """Position of the first rule that rejects each document, -1 for none; later rules see only what is left."""
    verdict, left = np.full(part.n, -1), np.arange(part.n)
    for k, rule in enumerate(rules):
        bad = rule.rejects(part)
        verdict[left[bad]] = k
        if bad.all():
            break
        if bad.any():
            left, part = left[~bad], _thinned(part, ~bad)
    return verdict


def _thinned(part: Slice, keep: np.ndarray) -> Slice:
    """The kept documents with the measures per document that exist already."""
    starts, ends = part.offsets[:-1][keep], part.offsets[1:][keep]
    sizes = ends - starts
    flags = np.repeat(keep, np.diff(part.offsets))
    out = Slice(part.data[flags], np.concatenate([[0], np.cumsum(sizes)]))
    out.made = {k: v[keep] for k, v in part.made.items() if isinstance(v, np.ndarray) and len(v) == part.n and k.startswith(("n_", "word_chars", "short_", "letters"))}
    return out


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, measures: bool = False, reasons: bool = False) -> DataFrame:
    """doc_id, base_failed and kept for every document.

    measures: with the measures of MEASURES, which then are made for every document; without them a document's later measures are not made
    once a rule has rejected it. reasons: with rejected_by, the first rule in the order given (not in that of the cascade, which follows a
    clock) that rejects it; all rules see the rejected documents then. sample_rows: about how many rows the order of rules is estimated on; the verdict does not
    depend on it. Null and empty texts have no words and fail the base rule; equal rows give equal rows; an empty table gives an empty
    one; other columns than doc_id and text are not read.
    """
    rank = ordered(rules, sampled(docs, rules, sample_rows, BASE))
    first = list(BASE) if measures else ordered(BASE, sampled(docs, BASE, sample_rows, ()))
    columns = ["doc_id bigint", *(f"{m} bigint" for m in MEASURES if measures), "base_failed boolean", "kept boolean", *(["rejected_by string"] if reasons else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                s = Slice(*buffer(piece.column("text")))
                failed = base_failed(s) if measures else cascade(s, first) >= 0
                bad = failed.copy()
                if not failed.all():
                    bad[~failed] = cascade(_thinned(s, ~failed) if failed.any() else s, rank) >= 0
                out = [piece.column("doc_id"), *(pa.array(getattr(s, m).astype(np.int64)) for m in MEASURES if measures), pa.array(failed), pa.array(~bad)]
                if reasons:
                    names, some = np.full(s.n, None, object), _thinned(s, bad)
                    every = (*BASE, *rules)
                    by = cascade(some, list(every)) if some.n else np.zeros(0, np.int64)
                    names[np.flatnonzero(bad)] = [every[k].name for k in by.tolist()]
                    out.append(pa.array(names.tolist(), pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in columns])

    return docs.select("doc_id", "text").transform(mapped, run, ", ".join(columns))
