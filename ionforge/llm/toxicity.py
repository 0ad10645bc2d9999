"""Operator 8, toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs are words and characters: each word has a hashed embedding of its own
and the mean of hashed embeddings of its character 4-grams (with its borders).
A bidirectional GRU reads windows of ``WINDOW`` words that overlap by half, an
attention over its states pools them into one value per window, and a
document's score is that of its worst window.  All windows of the whole text
are scored.

The network is trained in numpy, on the driver, from at most ``fit_rows``
labelled rows of each class, those with the smallest hash of the id, and of
them those whose whole texts fit in ``fit_bytes`` in that order.  Labels
belong to documents, so training picks each toxic document's worst window and
the clean documents' random and worst windows, first by the embeddings'
evidence and then by the network.

Defined results: a text without words scores 0; repeated rows are scored one
by one; of labelled ids that several texts have, the first text in order is
learnt from; an id labelled both ways counts as toxic; null ids are carried; an
empty table gives an empty result; without labels of both classes every score
is 0.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, Words, mixed, sliced, spread, with_workers, written

FIT_ROWS = 1200
#: Bytes of their texts; a text that would go beyond is not learnt from.
FIT_BYTES = 32 << 20
WINDOW = 32
HIDDEN = 8
WORD_DIM, CHAR_DIM = 6, 6
WORD_BUCKETS, CHAR_BUCKETS = 1 << 15, 1 << 14
#: Passes over the training rows, and the least number of steps that they make.
EPOCHS, STEPS = 5, 150
#: Rows by which the evidence of a word or 4-gram is shrunk.
PRIOR = 2
FOLDS = 4
BLOCK = 2048

_WORDS = Words(LETTERS)


class Texts:
    """Some texts as word numbers: distinct words with their inputs, and windows of them."""

    def __init__(self, at: np.ndarray, data: np.ndarray, window: int = WINDOW):
        n = len(at) - 1
        h, start, end, row = _WORDS.split(at, data)
        self.n = n
        distinct, first, number = np.unique(h, return_index=True, return_inverse=True)
        self.words = (distinct & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
        self.grams, self.gram_start = self._grams(data, start[first], end[first])
        self.number, self.row = number, row
        # windows begin every half window; a row's last ones may be short
        count = np.bincount(row, minlength=n)
        half = window // 2
        each = np.where(count > 0, np.maximum(1, -(-(count - half) // half)), 0)
        self.of = np.repeat(np.arange(n), each)
        begin = np.cumsum(count) - count
        k = np.arange(len(self.of)) - np.repeat(np.cumsum(each) - each, each)
        place = k[:, None] * half + np.arange(window)
        inside = place < count[self.of][:, None]
        where = np.minimum(begin[self.of][:, None] + place, max(len(number) - 1, 0))
        self.windows = np.where(inside, number[where] if len(number) else 0, len(distinct)).astype(np.int32)

    @staticmethod
    def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Buckets of the character 4-grams of each word between two borders, and where each word's begin."""
        size = end - start
        wide = size + 4  # two zeros on each side
        first = np.cumsum(wide) - wide
        flat = np.zeros(int(wide.sum()) + 4, np.uint64)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        low = data[np.repeat(start, size) + inner]
        low = np.where((low >= 65) & (low <= 90), low + 32, low)
        flat[np.repeat(first + 2, size) + inner] = low
        g = flat[:-3] | flat[1:-2] << np.uint64(8) | flat[2:-1] << np.uint64(16) | flat[3:] << np.uint64(24)
        each = size + 1  # grams that do not reach the next word
        inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        return (mixed(g[np.repeat(first, each) + inner]) & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64), np.cumsum(each) - each


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """The parameters, forward and backward steps.

    Columns of the gates: update of both directions, reset of both, candidate
    of both; the recurrent weights keep the directions apart.
    """

    def __init__(self, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        f = np.float32
        self.word = (rng.standard_normal((WORD_BUCKETS, WORD_DIM)) * 0.05).astype(f)
        self.char = (rng.standard_normal((CHAR_BUCKETS, CHAR_DIM)) * 0.05).astype(f)
        self.w = (rng.standard_normal((d, 6 * h)) / np.sqrt(d)).astype(f)
        self.u = (rng.standard_normal((2 * h, 6 * h)) / np.sqrt(h)).astype(f)
        self.apart = np.zeros((2 * h, 6 * h), f)
        for k in range(3):
            self.apart[:h, 2 * k * h : (2 * k + 1) * h] = 1
            self.apart[h:, (2 * k + 1) * h : (2 * k + 2) * h] = 1
        self.u *= self.apart
        self.b = np.zeros(6 * h, f)
        self.v = (rng.standard_normal((2 * h, 2)) * 0.3).astype(f)  # attention, readout
        self.c = np.array([-1.0], f)
        self.scale = np.array([1.0, 0.0], f)

    def inputs(self, t: Texts) -> np.ndarray:
        """The input of each distinct word, and zeros for the place behind a text's end."""
        out = np.zeros((len(t.words) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if len(t.words):
            out[:-1, :WORD_DIM] = self.word[t.words]
            size = np.diff(np.append(t.gram_start, len(t.grams)))
            out[:-1, WORD_DIM:] = np.add.reduceat(self.char[t.grams], t.gram_start, axis=0) / np.sqrt(size)[:, None]
        return out

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Values of windows; ``x`` has the inputs by word number, its last row is the padding."""
        h2, n, steps = 2 * HIDDEN, len(windows), windows.shape[1]
        p = x @ self.w + self.b
        pad = len(x) - 1
        real = windows != pad
        state = np.zeros((n, h2), np.float32)
        att, read = np.full((n, steps, 2), -1e9, np.float32), np.zeros((n, steps, 2), np.float32)
        f_cols = np.r_[0:HIDDEN, h2 : h2 + HIDDEN, 2 * h2 : 2 * h2 + HIDDEN]
        pf, pb = p[:, f_cols], p[:, f_cols + HIDDEN]
        tape = []
        a = np.empty((n, 3, 2, HIDDEN), np.float32)
        for s in range(steps):
            i, j = windows[:, s], windows[:, steps - 1 - s]
            a[:, :, 0] = pf[i].reshape(n, 3, HIDDEN)
            a[:, :, 1] = pb[j].reshape(n, 3, HIDDEN)
            flat = a.reshape(n, 3 * h2)
            rec = state @ self.u
            zr = _sigmoid(flat[:, : 2 * h2] + rec[:, : 2 * h2])
            z, r = zr[:, :h2], zr[:, h2:]
            cand = np.tanh(flat[:, 2 * h2 :] + r * rec[:, 2 * h2 :])
            new = cand + z * (state - cand)
            mask = np.empty((n, 2, 1), np.float32)
            mask[:, 0, 0], mask[:, 1, 0] = real[:, s], real[:, steps - 1 - s]
            new = (new.reshape(n, 2, HIDDEN) * mask).reshape(n, h2)
            if keep:
                tape.append((state, z, r, cand, rec[:, 2 * h2 :].copy(), mask, new))
            state = new
            att[:, s, 0], read[:, s, 0] = (new[:, :HIDDEN] @ self.v[:HIDDEN]).T
            att[:, steps - 1 - s, 1], read[:, steps - 1 - s, 1] = (new[:, HIDDEN:] @ self.v[HIDDEN:]).T
        e = np.where(real, att.sum(2), -1e9)
        o = read.sum(2)
        e = np.exp(e - e.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        value = (e * o).sum(1) + self.c[0]
        return (value, (e, o, tape, real)) if keep else value

    def train_step(self, x: np.ndarray, windows: np.ndarray, y: np.ndarray):
        """Loss and gradients of w, u, b, v, c and x."""
        h2, n, steps = 2 * HIDDEN, len(windows), windows.shape[1]
        value, (e, o, tape, real) = self.forward(x, windows, keep=True)
        p = _sigmoid(value)
        dv = ((p - y) / n).astype(np.float32)
        do = dv[:, None] * e
        de = dv[:, None] * e * (o - (e * o).sum(1, keepdims=True))
        gw, gu, gb, gv = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b), np.zeros_like(self.v)
        gx = np.zeros_like(x)
        back = np.zeros((n, h2), np.float32)
        for s in range(steps - 1, -1, -1):
            state, z, r, cand, rec, mask, new = tape[s]
            sf, sb = s, steps - 1 - s
            df = np.stack([de[:, sf], do[:, sf]], 1)
            db = np.stack([de[:, sb], do[:, sb]], 1)
            gv[:HIDDEN] += new[:, :HIDDEN].T @ df
            gv[HIDDEN:] += new[:, HIDDEN:].T @ db
            d = back.copy()
            d[:, :HIDDEN] += df @ self.v[:HIDDEN].T
            d[:, HIDDEN:] += db @ self.v[HIDDEN:].T
            d = (d.reshape(n, 2, HIDDEN) * mask).reshape(n, h2)
            dcand = d * (1 - z) * (1 - cand * cand)
            dz = d * (state - cand) * z * (1 - z)
            dr = dcand * rec * r * (1 - r)
            da = np.concatenate([dz, dr, dcand], 1)
            drec = np.concatenate([dz, dr, dcand * r], 1)
            back = d * z + drec @ self.u.T
            gu += state.T @ drec
            gb += da.sum(0)
            for half, at in ((0, windows[:, sf]), (1, windows[:, sb])):
                cols = np.r_[0:HIDDEN, h2 : h2 + HIDDEN, 2 * h2 : 2 * h2 + HIDDEN] + half * HIDDEN
                part = da[:, cols]
                gw[:, cols] += x[at].T @ part
                np.add.at(gx, at, part @ self.w[:, cols].T)
        gx[-1] = 0
        loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
        return loss, {"w": gw, "u": gu * self.apart, "b": gb, "v": gv, "c": np.array([dv.sum()], np.float32)}, gx

    def values(self, t: Texts) -> np.ndarray:
        """The value of each window."""
        x = self.inputs(t)
        return np.concatenate([self.forward(x, t.windows[i : i + BLOCK]) for i in range(0, len(t.windows), BLOCK)] or [np.zeros(0, np.float32)])

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score for each text, 0 for one without words."""
        out = np.zeros(len(texts))
        for first, at, data in _WORDS.chunks(texts):
            t = Texts(at, data)
            if len(t.of):
                worst = np.full(t.n, -np.inf)
                np.maximum.at(worst, t.of, self.values(t))
                some = worst > -np.inf
                out[first : first + t.n][some] = _sigmoid(np.clip(self.scale[0] * worst[some] + self.scale[1], -30, 30))
        return out


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """A network trained on whole texts with their documents' labels.

    The first dimension of each embedding is the evidence, the log odds of
    documents that hold the word or 4-gram.  While training, a document's
    evidence comes from the other folds only; later it comes from all.
    """
    net = Network(seed)
    rng = np.random.Generator(np.random.PCG64(seed))
    fold = rng.permutation(len(texts)) % FOLDS
    parts, labels = [], []
    for k in range(FOLDS):
        if (fold == k).any():
            parts.append(Texts(*_joined([texts[i] for i in np.flatnonzero(fold == k)])))
            labels.append(y[fold == k])
    counts = [_counts(t, v) for t, v in zip(parts, labels, strict=True)]
    total = tuple(sum(c[i] for c in counts) for i in range(4))
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    own = [tuple(n - c for n, c in zip(total, cs, strict=True)) if len(parts) > 1 else total for cs in counts]
    by = []
    for t in parts:
        by.append([(i, w) for i, w in enumerate(np.split(np.arange(len(t.of)), np.searchsorted(t.of, np.arange(1, t.n)))) if len(w)])
    epochs = max(epochs, -(-STEPS * 128 // max(1, 2 * sum(map(len, by)))))
    state: dict = {}
    values: dict[int, np.ndarray] = {}
    for epoch in range(epochs):
        batches = []
        for f, t in enumerate(parts):
            _evidence(net, own[f], share)
            if epoch == 0:
                # the embeddings' evidence alone: the sum of each window's strongest words
                x = net.inputs(t)
                value = np.sort((x[:, 0] + x[:, WORD_DIM])[t.windows], 1)[:, -2:].sum(1)
            elif epoch < EPOCHS:
                value = values[f] = net.values(t)
            else:
                value = values[f]
            pick, label = [], []
            for i, w in by[f]:
                worst = int(w[value[w].argmax()])
                few = [worst] if labels[f][i] else sorted({worst, *rng.choice(w, min(2, len(w)), replace=False).tolist()})
                pick += few
                label += [float(labels[f][i])] * len(few)
            order = rng.permutation(len(pick))
            pick, label = np.array(pick)[order], np.array(label, np.float32)[order]
            batches += [(f, pick[lo : lo + 128], label[lo : lo + 128]) for lo in range(0, len(pick), 128)]
        for k in rng.permutation(len(batches)):
            f, pick, label = batches[k]
            _evidence(net, own[f], share)
            _step(net, parts[f], parts[f].windows[pick], label, state)
    worst, truth = [], []
    for f, t in enumerate(parts):
        _evidence(net, own[f], share)
        value = net.values(t)
        worst += [value[w].max() for _, w in by[f]]
        truth += [labels[f][i] for i, _ in by[f]]
    _calibrate(net, np.array(worst), np.array(truth, float))
    _evidence(net, total, share)
    return net


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one chunk."""
    raw = [x.encode() for x in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return at, np.frombuffer(b"".join(raw), np.uint8)


def _evidence(net: Network, counts: tuple, share: float) -> None:
    """Set the evidence; counts are shrunk toward the share of toxic rows by PRIOR rows."""
    for table, a, b in ((net.word, *counts[:2]), (net.char, *counts[2:])):
        table[:, 0] = np.clip(np.log((a / share + PRIOR) / (b / (1 - share) + PRIOR)), -2, 4)


def _counts(t: Texts, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Toxic and other documents that hold each bucket of words, and of 4-grams."""
    pairs = np.unique(t.row * np.int64(len(t.words) + 1) + t.number)
    row, number = pairs // (len(t.words) + 1), pairs % (len(t.words) + 1)

    def both(keys: np.ndarray, rows: np.ndarray, buckets: int):
        pair = np.unique(keys * np.int64(t.n) + rows)
        k, r = pair // t.n, pair % t.n
        return np.bincount(k, y[r], buckets), np.bincount(k, 1 - y[r], buckets)

    size = np.diff(np.append(t.gram_start, len(t.grams)))
    owner = np.repeat(np.arange(len(t.words)), size)
    # rows of each gram: through the words that hold it
    order = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[order], np.arange(len(t.words) + 1))
    keys, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(owner), 1 << 18):
        o, g = owner[lo : lo + (1 << 18)], t.grams[lo : lo + (1 << 18)]
        n = starts[o + 1] - starts[o]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rr = row[order[np.repeat(starts[o], n) + inner]]
        pair = np.unique(np.repeat(g, n) * np.int64(t.n) + rr)
        keys.append(pair // t.n)
        rows.append(pair % t.n)
    return *both(t.words[number], row, WORD_BUCKETS), *both(np.concatenate(keys), np.concatenate(rows), CHAR_BUCKETS)


def _step(net: Network, t: Texts, windows: np.ndarray, y: np.ndarray, state: dict, rate: float = 0.01) -> None:
    """One Adam step; embeddings by plain steps on the rows that the windows touch."""
    used, local = np.unique(windows, return_inverse=True)
    pad = len(t.words)
    real = used[used != pad]
    sub = Texts.__new__(Texts)
    sub.words = t.words[real]
    ends = np.append(t.gram_start, len(t.grams))
    size = ends[real + 1] - ends[real]
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    sub.grams, sub.gram_start = t.grams[np.repeat(ends[real], size) + inner], np.cumsum(size) - size
    x = net.inputs(sub)
    local = local.reshape(windows.shape)
    if len(real) == len(used):  # no padding among them: its row is the last all the same
        local = local.astype(np.int32)
    _, grads, gx = net.train_step(x, local, y)
    state["t"] = state.get("t", 0) + 1
    for name, g in grads.items():
        m, v = state.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        state[name] = (m, v)
        setattr(net, name, getattr(net, name) - (rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.99 ** state["t"])) + 1e-8)).astype(np.float32))
    gx[:, [0, WORD_DIM]] = 0  # the evidence stays
    np.subtract.at(net.word, sub.words, 0.5 * gx[:-1, :WORD_DIM])
    np.subtract.at(net.char, sub.grams, np.repeat(0.5 * gx[:-1, WORD_DIM:] / np.sqrt(size)[:, None], size, axis=0))


def _calibrate(net: Network, worst: np.ndarray, y: np.ndarray) -> None:
    """Scale and shift so that a score of 0.7 is where errors on both sides are fewest, half way between the classes there."""
    order = np.argsort(worst)
    v, l = worst[order], y[order]
    wrong = np.cumsum(l) / max(l.sum(), 1) + (1 - l).sum() / max((1 - l).sum(), 1) - np.cumsum(1 - l) / max((1 - l).sum(), 1)
    k = int(np.argmin(wrong))
    cut = (v[k] + v[min(k + 1, len(v) - 1)]) / 2
    net.scale = np.array([1.0, np.log(0.7 / 0.3) - cut], np.float32)


def fit_sample(docs: DataFrame, labels: DataFrame, held_out: Column, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", fit_bytes: int = FIT_BYTES):
    """At most ``fit_rows`` (text, label) of each class and ``fit_bytes`` of text, from rows that are not held out."""
    marked = labels.filter("toxic in (0, 1)").filter(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for k in (0, 1):
        some = marked.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 * fit_rows rows of two numbers
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = written(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-sample", most=2 * fit_rows)
    left, taken, total = fit_bytes, [], 0
    for doc_id, n in rows.select("doc_id", F.octet_length("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        total += 1
        if n <= left:
            left -= n
            taken.append(doc_id)
    return (rows if len(taken) == total else rows.filter(F.col("doc_id").isin(taken))).collect()


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    spark = docs.sparkSession
    with_workers(spark)
    rows = sorted(fit_sample(docs, labels, held_out("doc_id"), fit_rows, id_col, text_col), key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["toxic"] for r in rows], float)
    net = train([r["text"] for r in rows], y) if 0 < y.sum() < len(y) else None
    sent = spark.sparkContext.broadcast(net)
    idt = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        net = sent.value
        for b in sliced(batches):
            s = np.zeros(b.num_rows) if net is None else net.scores(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    out = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return spread(out).mapInArrow(run, f"id {idt}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
