"""Language identification by a byte convolutional network, trained here in numpy.

Text is cut into windows of a fixed number of bytes. A window's bytes are
embedded, run through filters of several widths, max-pooled over the window and
classified by softmax; a text's score of a language is its windows' mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.llm.common import small_batches

UNKNOWN = "und"
#: Bytes of a window.
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Labelled texts of each language that the network is fitted on, and windows taken from each.
SAMPLE_TEXTS = 500
SAMPLE_WINDOWS = 4
#: Texts of all languages together, where there are many languages.
SAMPLE_ALL = 100_000
EPOCHS = 14
_BATCH = 128
#: Windows that are run through the network at once.
_STEP = 256


def windows_of(text: bytes) -> np.ndarray:
    """All windows of a text, the last filled up with zero bytes; (0, WINDOW) if it is empty."""
    n = -(-len(text) // WINDOW)
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


@dataclass
class Network:
    """Weights; filters of all widths share one matrix, with zeros beyond a filter's width."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, filters) maxima and the columns of each window's bytes."""
        e = self.embed[np.pad(x, ((0, 0), (0, WIDTHS[-1] - 1)))]
        n = x.shape[1]
        columns = np.concatenate([e[:, k : n + k] for k in range(WIDTHS[-1])], axis=2)
        return (columns.reshape(-1, columns.shape[2]) @ self.filters).reshape(len(x), n, -1), columns

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x)[0].max(axis=1) + self.shift, 0) @ self.dense + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[bytes], targets: list[int], languages: list[str], seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Adam on cross entropy. Windows are cut short at random, so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    width = np.concatenate([np.full(FILTERS, w) for w in WIDTHS])
    mask = (np.arange(WIDTHS[-1])[:, None] < width).repeat(EMBEDDING, axis=0).astype(f32)
    embed = rng.normal(0, 0.5, (256, EMBEDDING)).astype(f32)
    embed[0] = 0
    filters = (rng.normal(0, 1, mask.shape) / np.sqrt(width * EMBEDDING)).astype(f32) * mask
    net = Network(languages, embed, filters, np.zeros(mask.shape[1], f32), rng.normal(0, 0.1, (mask.shape[1], len(languages))).astype(f32), np.zeros(len(languages), f32))
    if not texts:
        return net
    x = np.stack([np.frombuffer(t[:WINDOW].ljust(WINDOW, b"\0"), np.uint8) for t in texts])
    y = np.array(targets)
    names = ("embed", "filters", "shift", "dense", "bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step, rounds = 0, -(-len(x) // _BATCH) * epochs
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), -(-len(x) // _BATCH)):
            step += 1
            xb, yb = x[at].copy(), y[at]
            short = rng.random(len(xb)) < 0.4
            xb[(np.arange(WINDOW) >= rng.integers(8, WINDOW, len(xb))[:, None]) & short[:, None]] = 0
            maps, columns = net.pooled(xb)
            where = maps.argmax(axis=1)
            top = np.take_along_axis(maps, where[:, None, :], 1)[:, 0] + net.shift
            h = np.maximum(top, 0)
            z = h @ net.dense + net.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            dz = p / len(yb)
            dh = (dz @ net.dense.T) * (top > 0)
            picked = np.take_along_axis(columns, where[:, :, None], 1)  # (windows, filters, columns)
            grad = {"dense": h.T @ dz, "bias": dz.sum(0), "shift": dh.sum(0), "filters": np.einsum("wfc,wf->cf", picked, dh) * mask}
            back = (dh[:, :, None] * net.filters.T[None]).reshape(len(xb), -1, WIDTHS[-1], EMBEDDING)
            place = np.minimum(where[:, :, None] + np.arange(WIDTHS[-1]), WINDOW - 1)
            inside = where[:, :, None] + np.arange(WIDTHS[-1]) < WINDOW
            byte = np.take_along_axis(xb[:, None, :].repeat(where.shape[1], 1), place, 2)
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], byte[inside], back[inside])
            grad["embed"][0] = 0
            rate = 0.01 * (1 - step / (rounds + 1))
            for k in names:
                g = grad[k].astype(f32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                setattr(net, k, getattr(net, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    return net


def fold(id_col) -> object:
    """crc32 of the id as text, modulo 5; fold 0 (and a null id) is held out of the fit."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5, F.lit(0))


def _cuts(batches):
    """Up to SAMPLE_WINDOWS windows of each text, evenly spread over it."""
    for batch in batches:
        out, langs = [], []
        for text, lang in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist()):
            n = len(text) // WINDOW + (len(text) % WINDOW >= 8 or len(text) < WINDOW)
            for k in sorted({n * i // SAMPLE_WINDOWS for i in range(SAMPLE_WINDOWS)}) if n else ():
                out.append(text[k * WINDOW : (k + 1) * WINDOW])
                langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(langs, pa.string())], ["text", "lang"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Fit on a bounded sample: of each language the labelled texts outside fold 0 whose hashes of id and text are smallest.

    SAMPLE_TEXTS of each language, or fewer where so many languages would make more than SAMPLE_ALL, but one of each at
    least: every language that has a text is learned. Only text and label are used; rows that repeat id, text and label count
    once. The driver gets one row for each language and the sample's windows.
    """
    known = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & (fold(F.col("id")) != 0) & F.col("text").rlike(r"\p{L}"))
    known = known.select("text", "lang", F.xxhash64("id", "text").alias("hash"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    languages = sorted(counts)
    each = max(1, min(SAMPLE_TEXTS, SAMPLE_ALL // max(1, len(languages))))
    # a hash range that holds over twice the texts wanted of each language: few rows reach the ranking, however many there are
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, (2 * each + 20) / max(1, counts[k]))) for k in languages], "lang string, share double")
    # broadcast, one row for each language as the driver has them: a join by language would ship all texts, most of them to one task
    near = known.join(F.broadcast(shares), "lang").filter(F.pmod("hash", F.lit(1 << 32)) < F.when(F.col("share") >= 0.5, 1.0).otherwise(F.col("share")) * (1 << 32))
    near = near.groupBy("lang", "hash").agg(F.first("text").alias("text"))
    picked = near.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).filter(F.col("nth") <= each)
    rows = picked.select("text", "lang").mapInArrow(_cuts, "text binary, lang string").collect()
    place = {x: i for i, x in enumerate(languages)}
    rows = sorted((bytes(r.text), place[r.lang]) for r in rows if r.lang in place)
    return train([t for t, _ in rows], [k for _, k in rows], languages)


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _predict(net: Network):
    def batch(texts: pa.Array) -> pa.Array:
        out: list = [{"lang": UNKNOWN, "score": 0.0}] * len(texts)
        sums = np.zeros((len(texts), max(1, len(net.languages))))
        held, owner, n = [], [], 0

        def flush():
            nonlocal held, owner, n
            if held:
                x, who = np.concatenate(held), np.concatenate(owner)
                for i in range(0, len(x), _STEP):
                    np.add.at(sums, who[i : i + _STEP], net.probabilities(x[i : i + _STEP]))
            held, owner, n = [], [], 0

        known = []
        for i, text in enumerate(texts.to_pylist()):
            if text is None or not net.languages or not _has_letter(text):
                continue
            known.append(i)
            x = windows_of(text.encode())
            held.append(x)
            owner.append(np.full(len(x), i))
            n += len(x)
            if n >= 8 * _STEP:
                flush()
        flush()
        for i in known:
            k = int(sums[i].argmax())
            out[i] = {"lang": net.languages[k], "score": round(min(1.0, float(sums[i, k] / sums[i].sum())), 5)}
        return pa.array(out, pa.struct([("lang", pa.string()), ("score", pa.float64())]))

    return batch


def prediction(net: Network, text):
    """Column ``struct<lang, score>`` of a text column: every window of every text is classified."""
    return F.arrow_udf(_predict(net), "struct<lang:string,score:double>")(text)


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``(id_col, held_out, lang_pred, score)``.

    * Null texts and texts without a letter get ``und`` with score 0, as do all texts if no language was learned.
    * held_out: the id's fold is 0, so its label was not learned from; true for a null id.
    * Repeated rows each give a row; other columns are ignored.
    """
    rows = small_batches(docs).select(F.col(f"`{id_col}`").alias("id"), prediction(net, F.col(f"`{text_col}`")).alias("p"))
    return rows.select(F.col("id").alias(id_col), (fold(F.col("id")) == 0).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, net: Network, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose language is known with a score of ``least`` or more."""
    rows = small_batches(docs).select(F.struct("*").alias("row"))
    rows = rows.select("row", prediction(net, F.col("row").getField(text_col)).alias("p"))
    return rows.filter((F.col("p.lang") != UNKNOWN) & (F.col("p.score") >= least)).select("row.*")
