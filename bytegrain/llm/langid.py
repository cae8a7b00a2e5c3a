"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import mapped
from .text import LOWER, buffer, slices

#: Fixed: families of languages by their ISO 639-1 codes. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}
FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}
DIMENSIONS = 4096


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of lower-cased text, spaces around it included, and where each document's begin."""
    n = len(offsets) - 1
    padded = np.full(len(data) + 3 * n, 32, np.uint32)
    where = np.arange(len(data)) + np.repeat(3 * np.arange(n) + 2, np.diff(offsets))
    padded[where] = LOWER[data]
    code = (padded[2:] * np.uint32(0x9E3779B1) ^ padded[1:-1] * np.uint32(0x85EBCA6B) ^ padded[:-2] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
    begin = offsets[:-1] + 3 * np.arange(n)
    return code, np.append(begin, len(padded))


@dataclass
class Model:
    """Weights of all machines side by side; families and their languages, and the pairs of languages that machines separate."""

    families: list[tuple[str, list[str]]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        code, begin = codes(data, offsets)
        n = len(offsets) - 1
        if not self.families or not n:
            return ["und"] * n, np.zeros(n)
        step = 1 << 18
        sums = np.zeros((n, self.weights.shape[1]))
        for low in range(0, len(code), step):
            part = code[low : low + step]
            which = np.searchsorted(begin, [low, low + len(part) - 1], "right") - 1
            cut = np.clip(begin[which[0] : which[1] + 1] - low, 0, None)
            sums[which[0] : which[1] + 1] += np.add.reduceat(self.weights[part], cut, axis=0, dtype=np.float64)
        margins = sums / np.diff(begin)[:, None] + self.bias
        k = len(self.families)
        family = margins[:, :k].argmax(1)
        top = np.sort(margins[:, :k], axis=1)
        gap = top[:, -1] - (top[:, -2] if k > 1 else -top[:, -1])
        sure = 1 / (1 + np.exp(-np.clip(gap, -30, 30)))
        out: list[str] = [""] * n
        column = {pair: k + i for i, pair in enumerate(self.pairs)}
        for f, (_, langs) in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes, least = np.zeros((len(rows), len(langs))), np.full((len(rows), len(langs)), np.inf)
            for a, b in combinations(range(len(langs)), 2):
                m = margins[rows, column[langs[a], langs[b]]]
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
            best = (votes + 1e-3 * np.tanh(np.where(np.isfinite(least), least, 0))).argmax(1)
            for i, j in zip(rows.tolist(), best.tolist()):
                out[i] = langs[j]
            if len(langs) > 1:
                m = least[np.arange(len(rows)), best]
                sure[rows] *= 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
        return out, np.clip(sure, 0, 1)


def machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps; both classes weigh the same."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * cost
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (share * (x @ v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 1 / (1e-3 + 2.2 * size)
    w, z, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        grad = 1e-3 * z - 2 * x.T @ (share * y * slack)
        new = z - step * grad
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, learn, max_rows: int = 3000, max_langs: int = 150) -> Model:
    """Learns from the rows of `docs` where the column `learn` holds and lang and text are not null; other columns than doc_id, text and lang
    are not read. An empty table, or one without a language, gives a model that knows none.

    max_rows: at most so many rows (about; half as many again by the chance of hashes) reach the driver, equal numbers of each language,
    chosen by a hash of doc_id; this bounds what the driver holds to 8 kB a row. max_langs: the languages of most rows that are learned.
    """
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    n_of = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not n_of:
        return Model([], [], np.zeros((DIMENSIONS, 0)), np.zeros(0))
    each = max(20, max_rows // len(n_of))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in n_of], "lang string, share double")
    chance = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 18):
                code, begin = codes(*buffer(piece.column("text")))
                rows = []
                for a, b in zip(begin[:-1], begin[1:]):
                    x = np.bincount(code[a:b], minlength=DIMENSIONS) / max(1, b - a)
                    rows.append(x.astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([piece.column("lang"), piece.column("doc_id"), pa.array(rows, pa.binary())], ["lang", "doc_id", "x"])

    got = known.join(F.broadcast(shares), "lang").filter(chance < F.col("share")).select("lang", "doc_id", "text").transform(mapped, run, "lang string, doc_id bigint, x binary").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, DIMENSIONS)
    lang = np.array(got.column("lang").to_pylist())
    scale = 1 / (x.std(0) + 1e-4)
    x = x * scale
    norm = np.sqrt((x * x).sum(1).mean()) or 1.0
    x, scale = x / norm, scale / norm
    langs = sorted(set(lang.tolist()))
    names = sorted({FAMILY.get(v, v) for v in langs})
    families = [(f, [v for v in langs if FAMILY.get(v, v) == f]) for f in names]
    weights, bias = [], []
    for _, own in families:
        w, b = machine(x, np.where(np.isin(lang, own), 1.0, -1.0).astype(np.float32)) if len(families) > 1 else (np.zeros(DIMENSIONS, np.float32), 1.0)
        weights.append(w)
        bias.append(b)
    pairs = []
    for _, own in families:
        for a, b in combinations(own, 2):
            rows = (lang == a) | (lang == b)
            w, c = machine(x[rows], np.where(lang[rows] == a, 1.0, -1.0).astype(np.float32))
            pairs.append((a, b))
            weights.append(w)
            bias.append(c)
    return Model(families, pairs, np.ascontiguousarray((np.stack(weights, 1) * scale[:, None]).astype(np.float32)), np.array(bias))


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def predict(docs: DataFrame, model: Model, lettered: bool = False) -> DataFrame:
    """All columns of docs, then lang_pred and score (0 to 1).

    `und` with score 0 where text is null or has no letter; lettered: such rows are left out. A model that learned nothing says `und` too. An empty table gives an empty one. Columns named lang_pred or score are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                data, offsets = buffer(piece.column("text"))
                lang, score = sent.value.predict(data, offsets)
                has = np.concatenate([[0], np.cumsum(_LETTER[data])])
                keep = np.ones(piece.num_rows, bool)
                for i in np.flatnonzero(has[offsets[1:]] == has[offsets[:-1]]):
                    if not any(map(str.isalpha, piece.column("text")[int(i)].as_py() or "")):
                        lang[i], score[i], keep[i] = "und", 0.0, False
                out = pa.RecordBatch.from_arrays([*piece.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*piece.schema.names, "lang_pred", "score"])
                yield out.filter(pa.array(keep)) if lettered else out

    return docs.transform(mapped, run, f"{kinds}, lang_pred string, score double")


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
