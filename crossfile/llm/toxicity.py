"""Compression-distance classification: how much shorter windows get under a dictionary of toxic text.

Two zstandard dictionaries are trained from labelled texts in the manner of COVER: short byte strings are scored by how many
documents hold them, and the segments covering the best are kept. The ordinary dictionary scores strings by ordinary
documents; the toxic one holds the same segments followed by those whose strings are frequent in toxic and rare in ordinary
documents, so that a window's two lengths differ by what only toxic text explains. Of every text all windows are compressed
under both; a logistic model over the windows' gains is calibrated on labelled documents that the dictionaries haven't seen. Length
of window and size of the toxic dictionary are those of ``SETTINGS`` whose model is best, by its loss over folds of these documents;
rows held out take no part in that.

Fitted on at most ``SAMPLE`` labelled documents of each class, whole, by the least hashes of their ids, and on fewer where these have more than
``SAMPLE_BYTES`` together (a document that alone has more isn't sampled). Scoring reads whole texts of any length, window by window. Null and empty
texts score as texts without any gain. Ids with several or conflicting labels count by their greatest label. Repeated rows score alike, and one
of them is fitted on. Equal gains are worth the same, so no order decides a tie. Extra columns are ignored; an empty table gives no rows. Without both labels in the training part every
score is the share of toxic labels there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfile.llm.frames import text_key
from crossfile.llm.text import frugal

SAMPLE, SAMPLE_BYTES = 3000, 24 << 20
#: (bytes to a window, bytes of the toxic dictionary). Windows are so short that zstandard stores literals as they are: under entropy
#: coding, lengths vary by more than a match.
SETTINGS = [(w, n) for w in (32, 42) for n in (1536, 3072)]
FOLDS, OVERLAP = 3, 8
GRAM, SEGMENT = 6, 12
ORDINARY_BYTES = 512
#: A toxic string is in so many toxic documents at least, and by so much likelier there.
LEAST_TOXIC, LIFT = 4, 8
THRESHOLD = 0.3


def _norm(text: str | None) -> bytes:
    return (text or "").lower().encode()


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(strings of GRAM bytes as numbers, in how many of the texts each occurs)."""
    found = []
    for t in texts:
        b = np.frombuffer(t, dtype=np.uint8).astype(np.uint64)
        if len(b) >= GRAM:
            x = np.zeros(len(b) - GRAM + 1, dtype=np.uint64)
            for i in range(GRAM):
                x = x << np.uint64(8) | b[i : len(b) - GRAM + 1 + i]
            found.append(np.unique(x))
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def cover(grams: np.ndarray, score: np.ndarray, size: int) -> bytes:
    """Segments around the best strings, the best last. A string is extended by its best-scoring overlap."""
    best = np.argsort(-score, kind="stable")[: size // 2]
    best = best[score[best] > 0]
    left = {int(g): float(s) for g, s in zip(grams[best], score[best], strict=True)}
    mask = (1 << 8 * (GRAM - 1)) - 1
    heads: dict[int, list[int]] = {}
    for g in left:
        heads.setdefault(g >> 8, []).append(g)
    segments, total = [], 0
    for g in list(left):
        if left.pop(g, None) is None:
            continue
        text = g.to_bytes(GRAM, "big")
        while len(text) < SEGMENT:
            after = [x for x in heads.get(int.from_bytes(text[1 - GRAM :], "big") & mask, ()) if x in left]
            if not after:
                break
            x = max(after, key=lambda y: (left[y], y))
            del left[x]
            text += x.to_bytes(GRAM, "big")[-1:]
        segments.append(text)
        total += len(text)
        if total >= size:
            break
    return b"".join(reversed(segments))[-size:]


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, prior: float, weights: np.ndarray | None = None, window: int = 42):
        self.ordinary, self.toxic, self.prior, self.weights, self.window = ordinary, toxic, prior, weights, window
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _coders(self):
        if self._ready is None:
            made = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                near = zstandard.ZstdCompressionParameters.from_level(9, source_size=self.window, dict_size=len(content))
                # Only matches of a whole string count.
                how = zstandard.ZstdCompressionParameters(window_log=near.window_log, chain_log=near.chain_log, hash_log=near.hash_log, search_log=8, min_match=GRAM, target_length=64, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
            self._ready = made
        return self._ready

    def gains(self, text: str | None) -> np.ndarray:
        """Bytes that each window gets shorter under the toxic dictionary. Neighbouring windows overlap."""
        a, b = self._coders()
        data = _norm(text)
        parts = [data[i : i + self.window + OVERLAP] for i in range(0, max(len(data), 1), self.window)]
        return np.array([len(a.compress(x)) - len(b.compress(x)) for x in parts], dtype=float)

    @staticmethod
    def features(gains: np.ndarray) -> list[float]:
        """Mean and largest gain, number of windows, and how many and what share of them gain at least so much."""
        at_least = [float((gains >= k).sum()) for k in range(1, 8)]
        return [1.0, float(gains.mean()), float(gains.max()) / 10, float(np.log(len(gains))), *(x / len(gains) for x in at_least), *(float(np.log1p(x)) for x in at_least[1:])]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(self.gains(text)), self.weights), -50, 50))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-4 * np.eye(len(w)), x.T @ (weight * (y - p)) - 1e-4 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Mean loss of a model over folds of the documents, each scored by a model of the others."""
    fold, total = np.arange(len(y)) % FOLDS, 0.0
    for k in range(FOLDS):
        if len(set(y[fold != k])) < 2:
            return float("inf")
        z = x[fold == k] @ _logistic(x[fold != k], y[fold != k], weight[fold != k])
        total += float((weight[fold == k] * np.logaddexp(0, np.where(y[fold == k] == 1, -z, z))).sum())
    return total / weight.sum()


def train(toxic: list[str], ordinary: list[str], prior: float, settings: list[tuple[int, int]] | None = None) -> Model:
    """Dictionaries from two thirds of the sample; calibration, and the choice of the setting, on the rest."""
    if not toxic or not ordinary:
        return Model(b"", b"", prior)
    seen = [[_norm(t) for i, t in enumerate(ts) if i % 3 or len(ts) < 3] for ts in (toxic, ordinary)]
    (tk, tn), (ok, on) = map(_grams, seen)
    common = cover(ok, on.astype(float), ORDINARY_BYTES)
    there = tn / len(seen[0])
    elsewhere = (_lookup(ok, on, tk) + 0.5) / (len(seen[1]) + 1)
    either = (_lookup(ok, on, tk) + tn) / (len(seen[0]) + len(seen[1]))
    score = np.where((tn >= LEAST_TOXIC) & (there >= LIFT * elsewhere), tn * np.log(there / either), 0.0)
    pairs = [(t, y) for ts, y in ((toxic, 1.0), (ordinary, 0.0)) for i, t in enumerate(ts) if not i % 3 or len(ts) < 3]
    held = [pairs[i] for i in np.random.default_rng(len(pairs)).permutation(len(pairs))]
    y = np.array([y for _, y in held])
    # The sample holds as many of each class as it may; weights bring back their true shares.
    weight = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1))
    best = None
    for window, size in settings or SETTINGS:
        model = Model(common, common + cover(tk, score, size), prior, window=window)
        x = np.array([Model.features(model.gains(t)) for t, _ in held])
        loss = _loss(x, y, weight)
        if best is None or loss < best[0]:
            best = loss, model, x
    _, model, x = best
    model.weights = _logistic(x, y, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Train on the labelled documents outside the fold that is held out."""
    labels = labels.select(F.col(key).alias("_k"), "toxic").where("toxic is not null and _k is not null").where(text_key("_k") % 4 != 2).groupBy("_k").agg(F.max("toxic").alias("toxic"))
    shares = labels.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("t")).first()
    if not shares.n:
        return Model(b"", b"", 0.0)
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("t")).where(F.octet_length("t") > 0)

    def chosen(toxic: bool) -> list[str]:
        """The texts of least hashes, as many as there is room for: lengths come first, then the texts that fit."""
        ids = labels.where((F.col("toxic") == 1) == F.lit(toxic)).select("_k").orderBy(F.xxhash64("_k"), "_k").limit(2 * sample)
        found = texts.join(F.broadcast(ids), "_k").select(F.xxhash64("_k").alias("h"), F.xxhash64("t").alias("g"), "t")
        rows, room, fits = found.groupBy("h", "g").agg(F.max(F.octet_length("t")).alias("n")).orderBy("h", "g").limit(sample).collect(), SAMPLE_BYTES, []
        for r in rows:
            if r.n <= room:
                fits.append((r.h, r.g))
                room -= r.n
        wanted = docs.sparkSession.createDataFrame(fits, "h long, g long")
        return [r.t for r in found.join(F.broadcast(wanted), ["h", "g"]).groupBy("h", "g").agg(F.first("t").alias("t")).orderBy("h", "g").collect()]

    return train(chosen(True), chosen(False), (shares.t or 0) / shares.n)


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """held_out, score and predicted of every row."""
    docs = docs.select(key, text, (text_key(key) % 4 == 2).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.array([model.score(t) for t in b.column(1).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return docs.mapInArrow(frugal(run), f"`{key}` {docs.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")
