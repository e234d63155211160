"""Language identification by a byte convolutional network.

Text is cut into windows of a fixed number of UTF-8 bytes; the whole text is read. The network embeds each byte,
applies filters of several widths, max-pools over the window and ends in a softmax. It is trained with numpy on a
bounded sample of windows of labelled rows (``rows_per_language`` and ``windows_per_row``, parameters). For scoring, embedding and filters are folded
into lookup tables over byte pairs, so a filter response is a sum of one or two table rows: the same function, without
the multiplications. A document's distribution is the mean over its windows, weighted by their bytes.

Results for special input: null text, or text without a letter (Unicode category L), is ``und`` with score 0; null or repeated ids are
passed through; rows with a null label are never learned from; an empty table gives an empty result, and with no
labelled rows every document is ``und`` with score 0; other columns are ignored. Ties go to the first label in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, returning, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
MOST_LABELS = 10_000
_LETTER = re.compile(r"[^\W\d_]+")  # letters, and numbers that are no decimal digits, such as a half


def has_letter(text: str) -> bool:
    """Whether text has a character of the Unicode category L."""
    return any(any(map(str.isalpha, m[0])) for m in _LETTER.finditer(text))


def cut(raw: bytes) -> np.ndarray:
    """All of raw as rows of WINDOW bytes; the last row is filled up with zeros."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw + b"\0" * (n * WINDOW - len(raw)), np.uint8).reshape(n, WINDOW)


class ByteCNN:
    """Embedding, filters of WIDTHS, max pooling, softmax; trained by Adam in numpy."""

    def __init__(self, labels: list[str], embedding: int = 8, filters: int = 12, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels, self.filters = labels, filters
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.w = {"E": rng.normal(0, 0.5, (256, embedding)).astype(np.float32), "V": draw(len(WIDTHS) * filters, len(labels)), "c": np.zeros(len(labels), np.float32)}
        for k in WIDTHS:
            self.w[f"F{k}"], self.w[f"b{k}"] = draw(k * embedding, filters), np.zeros(filters, np.float32)

    def _step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for a batch of windows."""
        w, n = self.w, len(x)
        e = w["E"][x]  # n, WINDOW, d
        pooled, kept = [], []
        for k in WIDTHS:
            cols = np.concatenate([e[:, i : e.shape[1] - k + 1 + i] for i in range(k)], axis=2)
            r = cols @ w[f"F{k}"] + w[f"b{k}"]
            at = r.argmax(axis=1)
            m = np.take_along_axis(r, at[:, None], 1)[:, 0]
            kept.append((cols, at, m > 0))
            pooled.append(np.maximum(m, 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ w["V"] + w["c"]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        loss = float(-(weight * np.log(p[np.arange(n), y] + 1e-9)).sum() / n)
        p[np.arange(n), y] -= 1
        dz = p * (weight / n)[:, None]
        g = {"V": h.T @ dz, "c": dz.sum(axis=0), "E": np.zeros_like(w["E"])}
        dh = dz @ w["V"].T
        d = w["E"].shape[1]
        for j, k in enumerate(WIDTHS):
            cols, at, on = kept[j]
            dm = dh[:, j * self.filters : (j + 1) * self.filters] * on
            picked = np.take_along_axis(cols, at[:, :, None], 1)  # n, filters, k*d: the window that won
            g[f"F{k}"] = np.einsum("nfc,nf->cf", picked, dm)
            g[f"b{k}"] = dm.sum(axis=0)
            back = dm[:, :, None] * w[f"F{k}"].T[None]  # n, filters, k*d
            for i in range(k):
                np.add.at(g["E"], np.take_along_axis(x, at + i, 1).ravel(), back[:, :, i * d : (i + 1) * d].reshape(-1, d))
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 1200, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteCNN:
        """The same number of steps whatever the number of rows, so that few rows are learned as well; the rate falls to a 32nd."""
        rng = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.labels)) / max(1, len(y))
        weight = (1 / np.maximum(share, 1e-9) / len(self.labels)).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        t = 0
        while len(x) and t < steps:
            order = rng.permutation(len(x))
            for s in range(0, min(len(x), (steps - t) * batch), batch):
                o = order[s : s + batch]
                _, g = self._step(x[o], y[o], weight[y[o]])
                t += 1
                step = rate * 0.5 ** (5 * t / steps)
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.w[k] -= step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)
        return self

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables over byte pairs (all widths' first two bytes), third bytes, and third and fourth bytes."""
        e, d, w = self.w["E"], self.w["E"].shape[1], self.w
        per = lambda k, i: e @ w[f"F{k}"][i * d : (i + 1) * d]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        lead = np.concatenate([pair(per(k, 0), per(k, 1)) + w[f"b{k}"] for k in WIDTHS], axis=1).astype(np.float32)
        return lead, np.ascontiguousarray(per(3, 2)), pair(per(4, 2), per(4, 3)).astype(np.float32)

    def predict(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], chunk: int = 128) -> np.ndarray:
        """Softmax rows for windows x."""
        lead, third, tail = tables
        f, out = self.filters, np.empty((len(x), len(self.labels)), np.float32)
        for s in range(0, len(x), chunk):
            b = x[s : s + chunk]
            pairs = (b[:, :-1].astype(np.intp) << 8) | b[:, 1:]
            r = lead[pairs]
            h = np.concatenate(
                [r[:, :, :f].max(axis=1), (r[:, :-1, f : 2 * f] + third[b[:, 2:]]).max(axis=1), (r[:, :-2, 2 * f :] + tail[pairs[:, 2:]]).max(axis=1)], axis=1
            )
            z = np.maximum(h, 0) @ self.w["V"] + self.w["c"]
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            out[s : s + chunk] = p / p.sum(axis=1, keepdims=True)
        return out


def sample(labelled: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_language: int, windows_per_row: int = 2) -> list[tuple[str, str]]:
    """About rows_per_language rows of each label, picked by a hash of id and text; of each row windows_per_row windows, as (label, window).

    Windows of WINDOW characters are picked by hash from anywhere in the whole text. The counts by label come first, so that rare
    labels are taken whole. Rows of one label, id and text are taken once. Each label is bounded by itself, to
    2 * rows_per_language, so no id and no label can crowd out others. More than MOST_LABELS labels are no languages: an error.
    """
    counts = [tuple(r) for r in labelled.groupBy(label_col).count().limit(MOST_LABELS + 1).collect()]
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counts:
        return []
    span = 1 << 30
    by = (F.col(id_col).cast("string"), F.col(text_col))
    key = F.pmod(F.xxhash64(*by), F.lit(span))
    under = labelled.sparkSession.createDataFrame([(label, min(span, int(span * rows_per_language / n) + 1)) for label, n in counts], "label string, under long")
    windows = []
    for k in range(windows_per_row):
        at = 1 + F.pmod(F.xxhash64(*by, F.lit(1 + k)), F.greatest(F.length(text_col) - WINDOW + 1, F.lit(1)).cast("long"))
        windows.append(F.substring(F.col(text_col), at.cast("int"), F.lit(WINDOW)))
    rows = labelled.select(F.col(label_col).cast("string").alias("label"), key.alias("key"), F.xxhash64(*by).alias("hash"), F.array(*windows).alias("windows"))
    picked = rows.join(F.broadcast(under), "label").where("key < under").drop("under").distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("key", "hash", "windows"))
    found = picked.withColumn("place", place).where(F.col("place") <= 2 * rows_per_language).collect()
    return [(r.label, w) for r in sorted(found, key=lambda r: (r.key, r.hash, r.label, r.windows)) for w in r.windows]


def train(rows: list[tuple[str, str]], seed: int = 5) -> ByteCNN | None:
    """A model from (label, window) rows. Of each, a part of mixed length is learned too, so that short texts are known."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for label, _ in rows})
    if not labels:
        return None
    x, y = [], []
    for k, (label, text) in enumerate(rows):
        raw = text.encode("utf-8", "replace")
        size = WINDOW if k % 2 else int(2 ** rng.uniform(2.5, 8))
        at = int(rng.integers(0, max(1, len(raw) - size + 1)))
        part = raw[at : at + size]
        if part:
            x.append(part + b"\0" * (WINDOW - len(part)))
            y.append(labels.index(label))
    return ByteCNN(labels).fit(np.frombuffer(b"".join(x), np.uint8).reshape(-1, WINDOW).astype(np.intp), np.array(y))


def identify(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), sure: str | None = None) -> DataFrame:
    """The keep columns (by default the id) with lang_pred and score, and if named, sure: the mean of each window's own best score, by bytes."""
    keep = keep or (id_col,)
    source = docs.select(*dict.fromkeys((*keep, text_col)))
    place = source.columns.index(text_col)
    out = [c for c in source.columns if c in keep]
    at = [source.columns.index(c) for c in out]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.fold() if model else None
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            label, score, each = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
            for group in _by_size(some, texts):
                raws = [texts[i].encode("utf-8", "replace") for i in group]
                windows = [cut(r) for r in raws]
                p = model.predict(np.concatenate(windows), tables)
                end = np.cumsum([len(w) for w in windows])
                used = np.full(len(p), WINDOW, np.float32)
                used[end - 1] = [len(r) - (len(w) - 1) * WINDOW for r, w in zip(raws, windows, strict=True)]
                total = np.add.reduceat(used, np.r_[0, end[:-1]])
                mean = np.add.reduceat(p * used[:, None], np.r_[0, end[:-1]], axis=0) / total[:, None]
                tops = np.add.reduceat(p.max(axis=1) * used, np.r_[0, end[:-1]]) / total
                for i, m, top in zip(group, mean, tops, strict=True):
                    best = int(m.argmax())
                    label[i], score[i], each[i] = model.labels[best], min(1.0, float(m[best])), min(1.0, float(top))
            found = [pa.array(label, pa.string()), pa.array(score, pa.float64()), *([pa.array(each, pa.float64())] if sure else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in at), *found], [*out, "lang_pred", "score", *([sure] if sure else [])])

    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in out)
    return source.mapInArrow(returning(scan), f"{schema}, lang_pred string, score double" + (f", `{sure}` double" if sure else ""))


def _by_size(places: list[int], texts: list[str], most: int = 1 << 20) -> Iterator[list[int]]:
    """Groups of about most characters, so that memory does not follow the batch."""
    group, size = [], 0
    for i in places:
        group.append(i)
        size += len(texts[i])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, rows_per_language: int = 1500, windows_per_row: int = 2) -> ByteCNN | None:
    """A model from the rows that are not held out and have a label and text."""
    known = need(docs, "doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0))
    return train(sample(known, "doc_id", "text", "lang", rows_per_language, windows_per_row))


def query(docs: DataFrame) -> DataFrame:
    return identify(need(docs, "doc_id", "text"), learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
