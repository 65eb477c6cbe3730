"""Quality by hashed word n-gram logistic regression with follow-the-regularised-leader updates.

A text is a run of tokens (letters, digits, or signs), each with its form: the
kind of its characters, its capitals, its length class and whether it repeats
the token before. Features are hashed n-grams: words alone and in pairs, and
forms in runs of one to three, as shares of the text. A bounded sample of
labelled texts trains the weights, coordinate by coordinate; scoring is a
sparse dot product in one pass over all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import common as C
from larkspur.llm import kernels as K

BITS = 18
#: The classifier learns from at most this many labelled texts, those first by the hash of their id.
MAX_TRAINING = 6000
#: and from so much of all their texts at most, in bytes: longer texts go to the end of the sample.
MAX_TRAINING_BYTES = 64 << 20
#: A text over this many bytes is not learned from (it is scored like any other).
MAX_TRAINING_TEXT = 1 << 20
#: Tokens counted at a time, and bytes of whole texts featured at a time.
CHUNK, RUN_BYTES = 1 << 16, 1 << 19

_KIND = np.where(K.LETTER_BYTE | (K._bytes >= 128), 1, np.where(K.DIGIT_BYTE, 2, np.where(K.SPACED, 3, 0))).astype(np.uint8)


def _kind_change(piece: np.ndarray) -> np.ndarray:
    kind = _KIND[piece]
    cut = np.zeros(len(piece), bool)
    cut[1:] = kind[1:] != kind[:-1]
    return cut


def _counted(data: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (text, feature) keys of a run of tokens and their counts; the first skip tokens only stand before the others."""
    size = end - start
    capitals = np.add.reduceat(K.UPPER_BYTE[data[start[0] : end[-1]]].view(np.uint8), start - start[0], dtype=np.int32)
    case = np.where(capitals == 0, 0, np.where((capitals == size) & (size > 1), 3, np.where(K.UPPER_BYTE[data[start]], 1, 2)))
    follows = np.zeros(len(text), bool)
    follows[1:] = text[1:] == text[:-1]
    repeats = np.zeros(len(text), bool)
    repeats[1:] = follows[1:] & (h[1:] == h[:-1])
    apart = np.ones(len(text), bool)
    apart[1:] = (start[1:] != end[:-1]) | ~follows[1:]
    kind = _KIND[data[start]].astype(np.int64)
    sign = np.where(kind == 3, data[start], 0).astype(np.int64)
    form = ((((sign * 4 + kind) * 4 + case) * 8 + np.minimum(7, np.log2(size).astype(np.int64))) * 2 + repeats) * 2 + apart
    form = K.mix(form.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    word = h ^ (case.astype(np.uint64) << np.uint64(7))
    three = np.zeros(len(text), bool)
    three[2:] = follows[2:] & follows[1:-1]
    before, form1, form2 = np.roll(word, 1), np.roll(form, 1), np.roll(form, 2)
    odd = np.uint64(0x2545F4914F6CDD1D)
    asked = np.arange(len(text)) >= skip
    wide = np.int32 if (int(text[-1]) + 1) << BITS < 1 << 31 else np.int64
    owner = text.astype(wide) << wide(BITS)

    def keys(chosen: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        return owner[chosen] | (K.mix(hashed[chosen]) >> np.uint64(64 - BITS)).astype(wide)

    found = np.concatenate([keys(asked, word), keys(asked & follows, before * odd + word), keys(asked, form + odd), keys(asked & follows, (form1 * odd + form) * odd), keys(asked & three, ((form2 * odd + form1) * odd + form) * odd + odd)])
    found.sort()
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
    return found[first].astype(np.int64), np.diff(np.append(first, len(found)))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """→ text number, hashed feature, value: sorted, one entry per feature of a text.

    Tokens are counted CHUNK at a time, so that beside the text itself and its
    distinct features little memory is taken, whatever the text's length.
    """
    offsets, data = K.utf8(column)
    text, start, end, h = K.words(offsets, data, K.SPACED, _kind_change)
    n = len(offsets) - 1
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [(keys, count)]
    for lo in range(0, len(text), CHUNK):
        a, b = max(0, lo - 3), min(len(text), lo + CHUNK)
        parts.append(_counted(data, text[a:b], start[a:b], end[a:b], h[a:b], lo - a))
        if len(parts) > 16 or b == len(text):
            keys, count = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys, kind="stable")
            keys, count = keys[order], count[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            parts = [(keys[first], np.add.reduceat(count, first))]
    keys, count = parts[0]
    owner, feature = keys >> BITS, keys & ((1 << BITS) - 1)
    value = np.sqrt(count / K.counts_per_text(text, n)[owner])
    norm = np.sqrt(np.bincount(owner, value * value, minlength=n))
    return owner, feature, value / norm[owner] * 3


class Ftrl:
    """Logistic regression with per-coordinate follow-the-regularised-leader (proximal) updates."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 0.2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        size = (1 << BITS) + 1  # the last is the bias
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, feature: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(feature, 1 << BITS), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAINING, epochs: int = 3) -> np.ndarray:
    """Weights from labelled texts outside the held-out fold (crc32 of the id's text mod 4 = 2).

    At most max_rows labels are used, first by the hash of the id; rows with a
    null id or label are left out, repeated labels of an id count once (the
    smallest). Without any label all weights are 0 and every score is 0.5.
    """
    spark = C.prepare(docs.sparkSession)
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    usable = usable.where(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2).groupBy("id").agg(F.min("label").alias("label"))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(max_rows)  # bounded: may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TRAINING_TEXT).join(F.broadcast(sample), "id")

    def fit(batches):
        rows, used = [], 0
        for batch in batches:
            room = MAX_TRAINING_BYTES - used
            used += batch.nbytes
            if room <= 0:
                continue
            for run in K.runs([batch], 1, RUN_BYTES):
                owner, feature, value = features(run.column(1))
                ends = np.searchsorted(owner, np.arange(len(run) + 1))
                ids, marks = run.column(0).to_pylist(), run.column(2).to_pylist()
                rows += [(ids[i], marks[i], feature[a:b].astype(np.int32), value[a:b].astype(np.float32)) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
        model = Ftrl()
        rng = np.random.default_rng(11)
        rows.sort(key=lambda r: (r[0], len(r[2])))
        for _ in range(epochs):
            for k in rng.permutation(len(rows)).tolist():
                model.learn(rows[k][2].astype(np.int64), rows[k][3].astype(float), rows[k][1])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f8").tobytes()])], names=["weights"])

    first = texts.select("id", "text", "label", F.xxhash64("id").alias("h")).repartition(1).sortWithinPartitions("h", "id").select("id", "text", "label")
    got = first.mapInArrow(fit, "weights binary").collect()
    return np.frombuffer(bytes(got[0][0]), "<f8") if got else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", keep: list[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns of docs and each text's score, under a name that is not among them.

    A null text is an empty one, which scores by the bias alone. Other columns
    stay as they are, whatever they hold; an empty table gives no row.
    """
    spark = C.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(weights)
    sent = [*keep, *([] if text_col in keep else [text_col])]
    chosen, at = docs.select(*[F.col(f"`{c}`") for c in sent]), sent.index(text_col)
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[: len(keep)]), f"`{name}` double"])

    def run(batches):
        w = shared.value
        for batch in K.runs(batches, at, RUN_BYTES):
            owner, feature, value = features(batch.column(at))
            dot = np.bincount(owner, w[feature] * value, minlength=len(batch)) if len(owner) else np.zeros(len(batch))
            p = 1 / (1 + np.exp(-np.clip(dot + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p)], names=[*batch.schema.names[: len(keep)], name])

    return chosen.mapInArrow(run, out)
