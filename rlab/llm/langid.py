"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` positions, read together with the ``MARGIN`` positions before and
behind them, so that windows can be run side by side and every position still has seen as much of the text on both sides.
One gated recurrent network runs forwards and one backwards; their states at a position give the probability of every
language there (a label for every position), and the mean over all positions of the whole text is the document's.

Training is backpropagation through time with Adam, on the driver, on a bounded sample of labelled rows: at most
``TRAIN_ROWS``, taken evenly from all languages by hash, and of all windows of their whole texts at most ``TRAIN_WINDOWS``,
again by hash. The weights (a fixed size for each language) are broadcast; prediction runs in Arrow batches over every byte
of every text.

Defined cases: a text that is null or has no letter is `und` with score 0; without any labelled row everything is
`und`; ties go to the first language by name; rows with a null label are not trained on; repeated rows are predicted
each; an empty table gives no rows; language, source and id are never inputs; extra columns are kept by ``keep_known``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rlab.llm.scan import U64, flat, mix, pieces

HIDDEN, WINDOW, MARGIN, BATCH = 8, 256, 16, 1024
#: Training takes shorter windows, of which a batch holds more different texts.
TRAIN_WINDOW = 64
TRAIN_ROWS, TRAIN_WINDOWS, EPOCHS, RATE, SEED, SPARE = 1200, 12_000, 3, 0.012, 5, 4
MIN_SCORE = 0.3
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, -1.0, out=x)
    np.exp(x, out=x)
    np.add(x, 1.0, out=x)
    return np.reciprocal(x, out=x)


class Network:
    """Weights by name. First axis: direction. ``table`` holds the input weights of every byte for the update gate, the
    reset gate and the candidate; ``recur`` the recurrent ones; ``bias`` that of the candidate's recurrent part."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.w = {
            "table": normal(0.3, 2, 3 * hidden, 256),
            "recur": normal(hidden**-0.5, 2, 3 * hidden, hidden),
            "bias": np.zeros((2, hidden, 1), np.float32),
            "out": normal(0.3, len(languages), 2 * hidden),
            "base": np.zeros((len(languages), 1), np.float32),
        }

    def states(self, data: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States (direction, step, hidden, window) of windows (position, window); the second direction's step t is at
        position -1 - t. ``mask`` is 0 where a short window has no byte; ``keep`` collects what the gradients need."""
        h, size, n = self.hidden, *data.shape
        table, recur, bias = self.w["table"], self.w["recur"], self.w["bias"]
        out = np.empty((2, size, h, n), dtype=table.dtype)
        state = np.zeros((2, h, n), dtype=table.dtype)
        x = np.empty((2, 3 * h, n), dtype=table.dtype)
        for t in range(size):
            np.take(table[0], data[t], axis=1, out=x[0], mode="clip")
            np.take(table[1], data[-1 - t], axis=1, out=x[1], mode="clip")
            a = recur @ state
            gates = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            q = a[:, 2 * h :] + bias
            cand = np.tanh(x[:, 2 * h :] + r * q)
            before, state = state, cand + z * (state - cand)
            if mask is not None:
                live = np.stack((mask[t], mask[-1 - t]))[:, None, :]
                state *= live
            if keep is not None:
                keep.append((z, r, q, cand, before))
            out[:, t] = state
        return out

    def infer(self, data: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """As ``states``, without what training needs: signs of the gates and the bias are folded into the weights, and all
        steps work in the same few arrays."""
        h, size, n = self.hidden, *data.shape
        sign = np.repeat(np.array([-1, 1], np.float32), (2 * h, h))[:, None]
        table = self.w["table"] * sign
        bias = np.concatenate((np.zeros((2, 2 * h, 1), np.float32), self.w["bias"]), axis=1)
        recur = np.concatenate((self.w["recur"] * sign, bias), axis=2)  # the state has a constant row
        out = np.empty((2, size, h, n), dtype=np.float32)
        state, x, a = np.zeros((2, h + 1, n), np.float32), np.empty((2, 3 * h, n), np.float32), np.empty((2, 3 * h, n), np.float32)
        state[:, h] = 1
        live, gates, cand, inner = state[:, :h], x[:, : 2 * h], x[:, 2 * h :], a[:, 2 * h :]
        with np.errstate(over="ignore"):
            for t in range(size):
                np.take(table[0], data[t], axis=1, out=x[0], mode="clip")
                np.take(table[1], data[-1 - t], axis=1, out=x[1], mode="clip")
                np.matmul(recur, state, out=a)
                gates += a[:, : 2 * h]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                inner *= gates[:, h:]
                cand += inner
                np.tanh(cand, out=cand)
                live -= cand
                live *= gates[:, :h]
                live += cand
                if mask is not None:
                    live[0] *= mask[t]
                    live[1] *= mask[-1 - t]
                out[:, t] = live
        return out

    def probabilities(self, states: np.ndarray, at: slice = slice(None)) -> np.ndarray:
        """(position, language, window) of the positions ``at``"""
        h = self.hidden
        logits = self.w["out"][:, :h] @ states[0][at] + self.w["out"][:, h:] @ states[1, ::-1][at] + self.w["base"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, mask: np.ndarray, labels: np.ndarray, core: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions (or those in ``core``), and its gradients by backpropagation through time.
        ``mask`` is 0 where a window reaches over its text."""
        h, size, n = self.hidden, *data.shape
        keep: list = []
        states = self.states(data, mask, keep)
        p = self.probabilities(states)
        core = mask if core is None else core
        weight = (core / core.sum())[:, None, :]
        loss = -float((np.log(p[:, labels, np.arange(n)] + 1e-9) * weight[:, 0]).sum())
        error = p * weight
        error[:, labels, np.arange(n)] -= weight[:, 0]
        w_out = self.w["out"]
        d = {k: np.zeros_like(v) for k, v in self.w.items()}
        d["base"] = error.sum(axis=(0, 2))[:, None]
        d["out"][:, :h] = np.einsum("tkn,thn->kh", error, states[0], optimize=True)
        d["out"][:, h:] = np.einsum("tkn,thn->kh", error, states[1, ::-1], optimize=True)
        into = np.stack((w_out[:, :h].T @ error, (w_out[:, h:].T @ error)[::-1]))
        inputs = np.empty((2, 3 * h, size, n), dtype=w_out.dtype)
        flow = np.zeros((2, h, n), dtype=w_out.dtype)
        back = self.w["recur"].transpose(0, 2, 1)
        for t in range(size - 1, -1, -1):
            z, r, q, cand, before = keep[t]
            flow = (flow + into[:, t]) * np.stack((mask[t], mask[-1 - t]))[:, None, :]
            d_cand = flow * (1 - z) * (1 - cand * cand)
            d_q = d_cand * r
            d_z = flow * (before - cand) * z * (1 - z)
            d_r = d_cand * q * r * (1 - r)
            d_a = np.concatenate((d_z, d_r, d_q), axis=1)
            inputs[:, :, t] = np.concatenate((d_z, d_r, d_cand), axis=1)
            d["recur"] += d_a @ before.transpose(0, 2, 1)
            d["bias"] += d_q.sum(axis=2, keepdims=True)
            flow = flow * z + back @ d_a
        for way, seen in enumerate((data, data[::-1])):
            for k in range(3 * h):
                d["table"][way, k] = np.bincount(seen.ravel(), weights=inputs[way, k].ravel(), minlength=256)
        return loss, d

    def train(self, windows: Windows, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 128, seed: int = SEED) -> list[float]:
        """Adam over shuffled batches of windows; the mean loss of every epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, losses = 0, []
        steps = epochs * -(-len(labels) // batch)
        for _ in range(epochs):
            order, total = rng.permutation(len(labels)), 0.0
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                data, mask, core = windows.batch(some)
                loss, grads = self.gradients(data, mask, labels[some], core)
                total += loss * len(some)
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(total / len(order))
        return losses

    def pool(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities of every text (text, language), and the share of its positions with each label."""
        raw, offsets = flat(texts)
        windows, doc = Windows.cut(raw, offsets)
        n, k = len(offsets) - 1, len(self.languages)
        total, votes = np.zeros((n, k)), np.zeros((n, k))
        inner = slice(MARGIN, MARGIN + WINDOW)
        whole = (windows.low == 0) & (windows.high == WINDOW + 2 * MARGIN)
        order = np.argsort(~whole, kind="stable")  # windows inside a text need no mask
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            data, mask, core = windows.batch(some)
            plain = bool(whole[some[-1]])
            p = self.probabilities(self.infer(data, None if plain else mask), inner)
            best = p.argmax(axis=1)
            if not plain:
                p *= core[inner, None, :]
                best[core[inner] == 0] = -1
            sums = p.sum(axis=0)
            for j in range(k):
                total[:, j] += np.bincount(doc[some], weights=sums[j], minlength=n)
                votes[:, j] += np.bincount(doc[some], weights=(best == j).sum(axis=0), minlength=n)
        length = np.maximum(1, np.diff(offsets) - 1)[:, None]
        return total / length, votes / length


@dataclass
class Windows:
    """Windows of texts with their margins (window, position; zeros outside the text) and the positions inside the text,
    from ``low`` on and below ``high``."""

    data: np.ndarray
    low: np.ndarray
    high: np.ndarray
    margin: int = MARGIN

    @classmethod
    def cut(cls, raw: np.ndarray, offsets: np.ndarray, size: int = WINDOW, margin: int = MARGIN) -> tuple[Windows, np.ndarray]:
        """All windows of all texts, and the text of each."""
        lengths = np.diff(offsets) - 1  # without the line feed behind each text
        counts = -(-lengths // size)
        doc = np.repeat(np.arange(len(lengths)), counts)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
        wide = size + 2 * margin
        low, high = np.maximum(0, margin - at), np.minimum(wide, lengths[doc] - at + margin)
        padded = np.concatenate((np.zeros(margin, np.uint8), raw, np.zeros(wide, np.uint8)))
        data = np.lib.stride_tricks.sliding_window_view(padded, wide)[offsets[doc] + at]
        edge = np.flatnonzero((low > 0) | (high < wide))
        place = np.arange(wide)
        data[edge] *= (place >= low[edge, None]) & (place < high[edge, None])
        return cls(data, low, high, margin), doc

    def batch(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, live positions and those of the windows without their margins (position, window)."""
        wide = self.data.shape[1]
        place = np.arange(wide)[:, None]
        mask = ((place >= self.low[some]) & (place < self.high[some])).astype(np.float32)
        core = mask * ((place >= self.margin) & (place < wide - self.margin))
        return np.ascontiguousarray(self.data[some].T), mask, core.astype(np.float32)


def held_out(docs: DataFrame) -> F.Column:
    """True for the quarter of ids that is never trained on."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: F.Column) -> F.Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(lang, text): about ``rows`` labelled rows outside the held-out quarter, evenly from all languages, those of least
    hash. Rows are counted by language first, and only hashes below a bound that leaves about ``SPARE * rows`` of each
    language are ranked, so a language that holds most rows does not fill one task. Texts move only when they are chosen."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(docs) & has_letter(F.col("text"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    bounds = [(lang, min((1 << 63) - 1, -(1 << 63) + (SPARE * rows << 64) // n)) for lang, n in counts.items()]
    bound = docs.sparkSession.createDataFrame(bounds, "lang string, _bound long")
    near = known.select("lang", "_h").join(F.broadcast(bound), "lang").where(F.col("_h") <= F.col("_bound")).distinct()
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_k") <= rows)
    chosen = ranked.orderBy("_k", "lang").limit(rows).select("lang", "_h")
    return known.join(F.broadcast(chosen), ["lang", "_h"], "left_semi").select("lang", "text")


_WINDOW = pa.schema([("lang", pa.string()), ("data", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("h", pa.int64())])


def training_windows(sample: DataFrame, most: int = TRAIN_WINDOWS) -> DataFrame:
    """(lang, data, low, high): of all windows of the whole texts of a sample at most ``most``, those of least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                raw, offsets = flat(piece.column("text"))
                windows, doc = Windows.cut(raw, offsets, TRAIN_WINDOW)
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                seed = np.array([zlib.crc32(t.as_buffer()) for t in piece.column("text").cast(pa.binary())], dtype=U64)
                h = mix(mix(seed[doc] + U64(SEED)) + place.astype(U64)) >> U64(1)
                columns = [piece.column("lang").take(pa.array(doc)), pa.array([w.tobytes() for w in windows.data], pa.binary()), *(pa.array(x.astype(np.int32)) for x in (windows.low, windows.high)), pa.array(h.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, schema=_WINDOW)

    found = sample.select("lang", "text").mapInArrow(run, "lang string, data binary, low int, high int, h long")
    return found.orderBy("h", "lang", "data").limit(most).drop("h")


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_WINDOWS) -> Network | None:
    """A network trained on the bounded sample; None without any labelled row."""
    sample = sorted(tuple(r) for r in training_windows(training_sample(docs, rows), most).collect())
    if not sample:
        return None
    languages, data, low, high = zip(*sample, strict=True)
    network = Network(sorted(set(languages)))
    windows = Windows(np.frombuffer(b"".join(map(bytes, data)), dtype=np.uint8).reshape(len(data), -1), np.array(low), np.array(high))
    network.train(windows, np.array([network.languages.index(lang) for lang in languages]))
    return network


_LABELS = "lang_pred string, score double, position_share double"


def predict(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and position_share (positions with the predicted label) of every row."""
    columns = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), has_letter(F.col(f"`{text_col}`")).alias("_letter"))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Network | None = shared.value
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(0).field(at)], names=["_row", "_letter", "text"])
            for piece in pieces(named, "text"):
                letter = np.asarray(piece.column("_letter").to_numpy(zero_copy_only=False), dtype=bool)
                names, scores, shares = [UNKNOWN] * piece.num_rows, np.zeros(piece.num_rows), np.zeros(piece.num_rows)
                if model is not None:
                    p, votes = model.pool(piece.column("text"))
                    best = p.argmax(axis=1)
                    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
                    rows = np.arange(len(best))
                    scores, shares = np.where(letter, np.clip(p[rows, best], 0, 1), 0.0), np.where(letter, votes[rows, best], 0.0)
                yield pa.RecordBatch.from_arrays([piece.column("_row"), pa.array(names, pa.string()), pa.array(scores), pa.array(shares)], names=["_row", "lang_pred", "score", "position_share"])

    return packed.mapInArrow(run, f"_row {packed.schema['_row'].dataType.simpleString()}, {_LABELS}")


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, position_share) of every row."""
    slim = docs.select("doc_id", "text")
    found = predict(slim, fit(docs, rows))
    return found.select("_row.doc_id", "lang_pred", "score", "position_share").select("doc_id", held_out(docs).alias("held_out"), "lang_pred", "score", "position_share")


def keep_known(docs: DataFrame, network: Network | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is known with at least ``min_score``, with all their columns."""
    found = predict(docs, fit(docs) if network is None else network)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("_row.*")
