"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of 64 bytes; two recurrent layers of gated units
read each segment from both ends, every position gets a distribution over the
languages from both states, and a document's probabilities are the mean over
all its positions.  The network is trained in numpy by backpropagation through
time, on a bounded sample of labelled rows: of every language that a training
row has, an equal share of ``SAMPLE_ROWS`` rows, but ``LANGUAGE_ROWS`` at least
(all, where there are fewer), those with the smallest hash of (doc_id, text),
repeated rows once; at most ``SEGMENTS_PER_ROW`` segments of each, spread over the
whole text.  Hashes are chosen first, and only segments come to the driver, so
what it gets does not depend on the rows' number or length.  Every document is
then read whole.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so
is every text if no row is labelled.  A null ``doc_id`` is never learned from
and not held out; repeated rows are predicted alike; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import text_buffer

SAMPLE_ROWS, LANGUAGE_ROWS, SEGMENTS_PER_ROW = 1200, 50, 8
UNITS, SEGMENT, LANES = 8, 64, 1024
STEPS, BATCH, RATE = 260, 192, 0.02
#: Stands beyond the end of a text: its update gate keeps the state.
PAD = 256
FOLDS, HELD_OUT = 3, 1

F4 = np.float32


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' bytes as segments x SEGMENT, padded; bytes in each; its row."""
    sizes = np.diff(offsets)
    count = -(-sizes // SEGMENT)
    row = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(SEGMENT, sizes[row] - k * SEGMENT)
    at = (offsets[row] + k * SEGMENT)[:, None] + np.arange(SEGMENT)
    x = data[np.minimum(at, max(len(data) - 1, 0))].astype(np.int16) if len(row) else np.zeros((0, SEGMENT), np.int16)
    x[np.arange(SEGMENT) >= length[:, None]] = PAD
    return x, length, row


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid."""
    return np.minimum(np.maximum(x + F4(0.5), F4(0)), F4(1))


class Network:
    """Gated recurrent units in both directions, lanes by features.

    ``table[d, g]`` (257 x h) is the input's share in gate g (update, reset,
    candidate) of direction d, ``u[d, g]`` (h x h) the state's, ``v[d]``
    (h x languages) and ``b`` the read-out.  Gates are piecewise linear sigmoids
    and candidates x / (1 + |x|): reading takes no transcendental function.
    """

    def __init__(self, languages: int, units: int = UNITS, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(F4)
        self.table = draw(2, 3, 257, units, scale=0.4)
        self.table[:, :2] *= F4(0.3)
        self.u = draw(2, 3, units, units, scale=1 / np.sqrt(units))
        self.u[:, :2] *= F4(0.3)
        self.v = draw(2, units, languages, scale=0.3)
        self.b = np.zeros(languages, F4)
        self.h = units
        self._pad()

    def _pad(self):
        self.table[:, :, PAD] = 0
        self.table[:, 0, PAD] = 1000

    def parameters(self):
        return [self.table, self.u, self.v, self.b]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of all positions of segments x with languages y, and its gradients."""
        n, steps = len(x), x.shape[1]
        real = x.T != PAD
        both, logits = [], np.tile(self.b, (steps, n, 1))
        for d in (0, 1):
            idx = x.T if d == 0 else x.T[::-1]
            state, kept = np.zeros((n, self.h), F4), []
            for t in range(steps):
                az, ar, ac = (self.table[d, k][idx[t]] for k in range(3))
                q = state @ self.u[d, 2]
                z, r = _gate(az + state @ self.u[d, 0]), _gate(ar + state @ self.u[d, 1])
                e = ac + r * q
                c = e / (1 + np.abs(e))
                kept.append((state, z, r, c, q))
                state = c + z * (state - c)
                logits[t if d == 0 else steps - 1 - t] += state @ self.v[d]
            both.append((idx, kept, state))
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        hit = p[:, np.arange(n), y]
        m = max(int(real.sum()), 1)
        loss = float(-(np.log(np.maximum(hit, 1e-12)) * real).sum() / m)
        out = p
        out[:, np.arange(n), y] -= 1
        out *= real[:, :, None] / F4(m)
        grads = [np.zeros_like(q) for q in self.parameters()]
        grads[3] += out.sum(axis=(0, 1))
        for d, (idx, kept, last) in enumerate(both):
            back, da = np.zeros((n, self.h), F4), np.empty((3, steps, n, self.h), F4)
            for t in range(steps - 1, -1, -1):
                state, z, r, c, q = kept[t]
                after = kept[t + 1][0] if t + 1 < steps else last
                o = out[t if d == 0 else steps - 1 - t]
                grads[2][d] += after.T @ o
                back = back + o @ self.v[d].T
                # the slope of x / (1 + |x|) is (1 - |c|) squared
                dc = back * (1 - z) * (1 - np.abs(c)) ** 2
                dz, dr = back * (state - c) * ((z > 0) & (z < 1)), dc * q * ((r > 0) & (r < 1))
                for k, g in enumerate((dz, dr, dc * r)):
                    grads[1][d, k] += state.T @ g
                da[0, t], da[1, t], da[2, t] = dz, dr, dc
                back = back * z + dz @ self.u[d, 0].T + dr @ self.u[d, 1].T + (dc * r) @ self.u[d, 2].T
            flat = idx.ravel()
            for k in range(3):
                for j in range(self.h):
                    grads[0][d, k, :, j] += np.bincount(flat, da[k, :, :, j].ravel(), 257)
        grads[0][:, :, PAD] = 0
        return loss, grads

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 2) -> list[float]:
        """Adam over random batches; the losses."""
        rng = np.random.default_rng(seed)
        params = self.parameters()
        m, s, losses = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            loss, grads = self.gradients(x[pick], y[pick])
            losses.append(loss)
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, a, b in zip(params, grads, m, s):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(F4)
            self._pad()
        return losses

    def positions(self, x: np.ndarray) -> np.ndarray:
        """steps x segments x languages: the distribution at every position."""
        n, steps, languages = len(x), x.shape[1], len(self.b)
        forward = np.ascontiguousarray(x.T).astype(np.int64)
        logits = np.empty((2, steps, n, languages), F4)
        z, r, c, g, s = (np.empty((n, self.h), F4) for _ in range(5))
        table = self.table.copy()
        table[:, :2] += F4(0.5)
        for d, idx in enumerate((forward, forward[::-1])):
            (tz, tr, tc), (uz, ur, uc) = table[d], self.u[d]
            s[:] = 0
            for t in range(steps):
                for gate, share, state_share in ((z, tz, uz), (r, tr, ur)):
                    np.take(share, idx[t], axis=0, out=gate, mode="clip")
                    np.matmul(s, state_share, out=g)
                    gate += g
                    np.maximum(gate, F4(0), out=gate)
                    np.minimum(gate, F4(1), out=gate)
                np.take(tc, idx[t], axis=0, out=c, mode="clip")
                np.matmul(s, uc, out=g)
                g *= r
                c += g
                np.abs(c, out=g)
                g += F4(1)
                c /= g
                s -= c
                s *= z
                s += c
                np.matmul(s, self.v[d], out=logits[d, t])
        p = logits[0]
        p += logits[1, ::-1]
        p += self.b
        np.exp(p, out=p)
        total = p[:, :, 0].copy()
        for k in range(1, languages):
            total += p[:, :, k]
        p /= total[:, :, None]
        return p

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """rows x languages: mean of the distributions over all positions of a row."""
        x, length, row = segments(data, offsets)
        total = np.zeros((len(offsets) - 1, len(self.b)))
        for at in range(0, len(x), LANES):
            part = x[at : at + LANES]
            p = self.positions(part)
            if (part[:, -1] == PAD).any():
                p *= (part.T != PAD)[:, :, None]
            np.add.at(total, row[at : at + LANES], p.sum(axis=0))
        return total / np.maximum(np.diff(offsets), 1)[:, None]


def _fold():
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def chosen(rows: DataFrame) -> list[tuple[str, int]]:
    """(lang, h) of the smallest hashes of every language, from rows (lang, h)."""
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return []
    each = max(LANGUAGE_ROWS, SAMPLE_ROWS // len(sizes))
    # hashes below a limit, of twice as many rows as needed, so that few are sorted
    wide = 2 * each + 40
    limits = [(lang, min(2**63 - 1, -(2**63) + 2**64 * wide // n)) for lang, n in sizes.items()]
    low = rows.join(F.broadcast(rows.sparkSession.createDataFrame(limits, "lang string, most bigint")), "lang").filter("h <= most")
    found: dict[str, list] = {lang: [] for lang in sizes}
    for r in low.select("lang", "h").distinct().collect():
        found[r["lang"]].append(r["h"])
    for lang, n in sizes.items():
        if len(found[lang]) < min(each, n):  # many repeated rows
            found[lang] = [r["h"] for r in rows.filter(F.col("lang") == lang).select("h").distinct().orderBy("h").limit(each).collect()]
    return sorted((lang, h) for lang, part in found.items() for h in sorted(part)[:each])


SAMPLE = "lang string, h bigint, data binary"


def _segments_of(batches):
    """Segments of each row (lang, h, text), evenly spread over it from a place that its hash gives."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        x, _, row = segments(data, offsets)
        first = np.searchsorted(row, np.arange(batch.num_rows + 1))
        out = []
        for k, h in enumerate(batch.column(1).to_pylist()):
            n = int(first[k + 1] - first[k])
            pick = np.random.default_rng(h % (1 << 63)).choice(n, min(n, SEGMENTS_PER_ROW), replace=False)
            out.append(x[first[k] + np.sort(pick)].astype("<i2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["lang", "h", "data"])


def learn(docs: DataFrame) -> tuple[list[str], Network | None]:
    """Languages and network from ``docs`` (doc_id, text, lang), all of them labelled."""
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND text <> ''").select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    picks = chosen(rows.select("lang", "h"))
    if not picks:
        return [], None
    languages = sorted({lang for lang, _ in picks})
    picked = F.broadcast(docs.sparkSession.createDataFrame(picks, "lang string, h bigint"))
    # repeated rows are one by their hash
    found = rows.join(picked, ["lang", "h"]).select("lang", "h", "text").mapInArrow(_segments_of, SAMPLE).dropDuplicates(["lang", "h"]).collect()
    xs, ys = [], []
    for r in sorted(found, key=lambda r: (r["h"], r["lang"])):
        xs.append(np.frombuffer(r["data"], "<i2").astype(np.int16).reshape(-1, SEGMENT))
        ys.append(np.full(len(xs[-1]), languages.index(r["lang"])))
    network = Network(len(languages))
    if len(languages) > 1:
        network.train(np.concatenate(xs), np.concatenate(ys))
    return languages, network


RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, languages: list[str], network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, network))  # a few thousand numbers

    def run(batches):
        names, net = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(3))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if net is None or not len(letters):
                pred, score = ["und"] * len(letters), np.zeros(len(letters))
            else:
                p = net.documents(data, offsets)
                best = p.argmax(axis=1)
                pred = [names[k] if there else "und" for k, there in zip(best, letters)]
                score = np.where(letters, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score.astype(float))], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(_fold() == HELD_OUT, F.lit(False))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), letters.alias("letters"), "text").mapInArrow(run, RESULT)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    return predict(docs, *learn(docs.filter(_fold() != HELD_OUT)))


def query(spark, sf_dir):
    """op9_language_id: see the contract."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
