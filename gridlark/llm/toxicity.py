"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word enters as its own hashed vector next to the pooled vectors of its character sequences, so words that were never
seen still carry their parts. A document is cut into windows that overlap by half; each window goes through the network
both ways, attention pools the states, and the document takes its highest window.

Training uses at most `TRAIN_DOCS` labelled documents in the order of the id's hash, a third of them toxic at most, and of a
longer text a run of `TRAIN_TEXT` characters that starts at a place drawn by the id's hash; of a document's windows the highest
ones learn its label. Rows of words and character sequences that few of these documents use stay zero, since they tell documents
apart and not labels. A fifth of the documents is kept back: it chooses among the rounds' averaged weights and sets the offset at
which 0.5 parts the labels, each label counting as often as it does among all labelled documents.

Scoring covers every window of every document. Runs of letters and digits longer than `LONGEST`, as in scripts without blanks,
enter as overlapping pieces, so that no character is left out.

Cases: null, empty and wordless texts get the score of a window without words; without labels of both kinds every score is
0; several label rows of one id count as their maximum; equal texts get equal scores; extra columns of the input are
ignored; of the rows that share a labelled id the least text is the one to learn from; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import held_out, text_of

WINDOW, STRIDE = 64, 32
TRAIN_DOCS, TRAIN_TEXT = 2400, 12_000
EARLY = 2  # rounds in which a document learns from windows drawn at random
LEAST_STEPS, STEP = 600, 64  # steps of a small sample, windows of a step
RARE = 150  # rows that fewer documents use than one in so many aren't learned
SMOOTH, THINNED = 0.1, 0.2  # what labels are taken to be wrong, character sequences left out in a round
KEPT_BACK, LEAST_KEPT = 5, 8  # one document in so many; fewer of a label set no offset
LONGEST, SHARED = 24, 8  # characters of a piece of a long run, and those that it shares with the next one
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 16
DIM, HIDDEN = 6, 8
GRAMS = (3, 4, 6, 8)
THRESHOLD = 0.5
CACHE = 400_000  # word types that a worker remembers
BATCH = 1024  # windows that go through the network together
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [p for w in words for p in ((w,) if len(w) <= LONGEST else (w[k : k + LONGEST] for k in range(0, len(w) - SHARED, LONGEST - SHARED)))]


def windows_of(n: int) -> list[int]:
    """Starts of the windows over n words: half-overlapping, the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character sequences of GRAMS bytes of each word with its ends marked: (ids, number for each word)."""
    raw = [b"<" + w.encode() + b">" for w in words]
    sizes = np.array([len(r) for r in raw])
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32) + 1
    ends = np.repeat(np.cumsum(sizes), sizes)
    places = np.arange(len(flat))
    ids, owner = [], []
    word_at = np.repeat(np.arange(len(words)), sizes)
    code = flat.copy()
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint32(0x9E3779B1) + flat[n - 1 :]
        if n in GRAMS:
            ok = places[: len(code)] + n <= ends[: len(code)]
            ids.append((code[ok] ^ code[ok] >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(16))
            owner.append(word_at[: len(code)][ok])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order].astype(np.int64) % GRAM_ROWS, np.bincount(owner, minlength=len(words))


def word_ids(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) % WORD_ROWS for w in words], dtype=np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pool_grams(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), table.shape[1]), dtype=np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[full] = np.add.reduceat(table[ids], starts, axis=0) / np.sqrt(sizes[full])[:, None]
    return out


def _gru(xp, mask, u, keep=None):
    """States of one direction. xp: projected inputs (time, rows, 3 hidden); keep: collects what the way back needs."""
    h = np.zeros((xp.shape[1], HIDDEN), dtype=np.float32)
    out = np.empty((*xp.shape[:2], HIDDEN), dtype=np.float32)
    for t in range(len(xp)):
        hu = h @ u
        zr = _sigmoid(xp[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(xp[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        new = np.where(mask[t][:, None], new, h)
        if keep is not None:
            keep.append((h, z, r, n, hu[:, 2 * HIDDEN :]))
        h = out[t] = new
    return out


def _gru_back(dout, mask, u, keep):
    """Gradients (of projected inputs, of u) from the gradients of the states."""
    dxp = np.zeros((*dout.shape[:2], 3 * HIDDEN), dtype=np.float32)
    du, dh = np.zeros_like(u), np.zeros(dout.shape[1:], dtype=np.float32)
    for t in range(len(dout) - 1, -1, -1):
        h, z, r, n, hn = keep[t]
        dh = dh + dout[t]
        live = dh * mask[t][:, None]
        dn, dz = live * (1 - z), live * (h - n)
        da = dn * (1 - n * n)
        dr = da * hn
        dpre = np.concatenate([dz * z * (1 - z), dr * r * (1 - r), da], axis=1)
        dhu = np.concatenate([dpre[:, : 2 * HIDDEN], da * r], axis=1)
        dxp[t] = dpre
        du += h.T @ dhu
        dh = dh - live + live * z + dhu @ u.T
    return dxp, du


class ToxicityModel:
    """The trained tables and weights; what is broadcast, about 3 MB."""

    def __init__(self, params: dict):
        self.p = params
        self.known: dict[str, int] = {}
        self.rows = None

    def __getstate__(self):
        return self.p

    def __setstate__(self, p):
        self.__init__(p)

    def inputs(self, types: list[str]) -> np.ndarray:
        ids, sizes = gram_ids(types)
        return np.concatenate([self.p["word"][word_ids(types)], _pool_grams(self.p["gram"], ids, sizes)], axis=1)

    def projected(self, types: list[str]) -> np.ndarray:
        x = self.inputs(types)
        return np.concatenate([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]], axis=1)

    def _ids(self, words: list[str]) -> np.ndarray:
        """Places of the words in the worker's table of projected inputs; new types are added."""
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if self.rows is None or len(known) + len(new) > max(CACHE, 2 * len(new)):
                known.clear()
                new = list(dict.fromkeys(words))
                self.rows = np.zeros((1, 6 * HIDDEN), dtype=np.float32)
                self.used = 1
            if self.used + len(new) > len(self.rows):
                more = max(self.used + len(new), 2 * len(self.rows))
                self.rows = np.concatenate([self.rows, np.zeros((more - len(self.rows), 6 * HIDDEN), np.float32)])
            self.rows[self.used : self.used + len(new)] = self.projected(new)
            known.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        return np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))

    def _logits(self, rows: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        xp = rows[ids.T]
        m = mask.T
        hf = _gru(xp[:, :, : 3 * HIDDEN], m, self.p["uf"])
        hb = _gru(xp[::-1, :, 3 * HIDDEN :], m[::-1], self.p["ub"])[::-1]
        h = np.concatenate([hf, hb], axis=2)
        e = np.tanh(h @ self.p["wa"] + self.p["ba"]) @ self.p["va"]
        a = np.exp(e - e.max(0)) * m
        a = a / np.maximum(a.sum(0), 1e-12)
        return (a[:, :, None] * h).sum(0) @ self.p["wo"] + self.p["bo"]

    def score(self, texts: list[str]) -> np.ndarray:
        """The highest window of each text, as a probability."""
        if "bo" not in self.p:
            return np.zeros(len(texts))
        out = np.full(len(texts), -np.inf)
        starts: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        flat: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        at = waiting = 0

        def run():
            nonlocal at, waiting
            if not waiting:
                return
            ids, first, n = np.concatenate(flat), np.concatenate(starts), np.concatenate(sizes)
            own = np.concatenate(owners)
            ids = np.append(ids, np.zeros(WINDOW, dtype=np.int64))
            for k in range(0, len(first), BATCH):
                part = slice(k, k + BATCH)
                mask = np.arange(WINDOW) < n[part, None]
                got = self._logits(self.rows, ids[np.minimum(first[part, None] + np.arange(WINDOW), len(ids) - 1)], mask)
                np.maximum.at(out, own[part], got)
            for x in (flat, starts, owners, sizes):
                x.clear()
            at = waiting = 0

        for k, text in enumerate(texts):
            words = words_of(text)
            if not words:
                out[k] = float(self.p["bo"][0])
                continue
            fill = len(self.known)
            if fill + len(words) > CACHE:
                run()  # a full cache is emptied only when no window waits for its rows
                self.rows = None
                self.known.clear()
            flat.append(self._ids(words))
            first = np.array(windows_of(len(words)))
            starts.append(first + at)
            sizes.append(np.full(len(first), min(WINDOW, len(words))))
            owners.append(np.full(len(first), k))
            at, waiting = at + len(words), waiting + len(first)
            if waiting >= 4 * BATCH:
                run()
        run()
        return _sigmoid(out)


def learned_rows(docs: list[np.ndarray], wid: np.ndarray, gids: np.ndarray, gstart: np.ndarray) -> dict[str, np.ndarray]:
    """The rows of words and character sequences that enough documents use."""
    words, grams = np.zeros(WORD_ROWS, dtype=np.int32), np.zeros(GRAM_ROWS, dtype=np.int32)
    for d in docs:
        types = np.unique(d)
        words[np.unique(wid[types])] += 1
        if len(types):
            grams[np.unique(np.concatenate([gids[gstart[w] : gstart[w + 1]] for w in types]))] += 1
    least = max(2, len(docs) // RARE)
    return {"word": words >= least, "gram": grams >= least}


def ranked_pairs(scores: np.ndarray, labels: np.ndarray) -> float:
    """The share of pairs of both labels that the scores order rightly; ties count half."""
    values, place = np.unique(scores, return_inverse=True)
    ones, zeros = (np.bincount(place[labels == y], minlength=len(values)) for y in (1, 0))
    return float((ones * (np.cumsum(zeros) - zeros / 2)).sum() / max(1, ones.sum() * zeros.sum()))


def best_cut(scores: np.ndarray, labels: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> float:
    """The cut with the highest F1, each label's rows counted by their weight; of nearly equal ones a low one, in favour of recall."""
    cuts = np.sort(scores)
    cuts = (cuts[1:] + cuts[:-1]) / 2
    pos, neg = np.sort(scores[labels == 1]), np.sort(scores[labels == 0])
    hit, wrong = weights[1] * (len(pos) - np.searchsorted(pos, cuts)), weights[0] * (len(neg) - np.searchsorted(neg, cuts))
    f1 = 2 * hit / np.maximum(1e-9, hit + wrong + weights[1] * len(pos))
    best = cuts[f1 >= f1.max() - 0.01]
    return float(best[len(best) // 4])


def train_numpy(texts: list[str], labels: np.ndarray, epochs: int = 6, seed: int = 7, weights: tuple[float, float] = (1.0, 1.0)) -> ToxicityModel:
    """Fits the network on labelled texts; in each round the highest windows of a document learn its label.

    weights: how many documents a text of label 0 and one of label 1 stand for.
    """
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel({})
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], dtype=np.int32) for t in texts]
    types = list(index)
    wid = word_ids(types)
    gids, gsizes = gram_ids(types)
    gstart = np.concatenate([[0], np.cumsum(gsizes)])
    learned = learned_rows(docs, wid, gids, gstart)
    p = {
        "word": rng.normal(0, 0.05, (WORD_ROWS, DIM)) * learned["word"][:, None], "gram": rng.normal(0, 0.05, (GRAM_ROWS, DIM)) * learned["gram"][:, None],
        "wf": rng.normal(0, 0.35, (2 * DIM, 3 * HIDDEN)), "wb": rng.normal(0, 0.35, (2 * DIM, 3 * HIDDEN)),
        "bf": np.zeros(3 * HIDDEN), "bb": np.zeros(3 * HIDDEN), "uf": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), "ub": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)),
        "wa": rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "ba": np.zeros(HIDDEN), "va": rng.normal(0, 0.3, HIDDEN),
        "wo": rng.normal(0, 0.3, 2 * HIDDEN), "bo": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mean = {k: v.copy() for k, v in p.items()}  # running averages of the weights
    wins, owner, size = [], [], []
    for k, d in enumerate(docs):
        for s in windows_of(len(d)) if len(d) else []:
            part = d[s : s + WINDOW]
            wins.append(np.pad(part, (0, WINDOW - len(part))))
            owner.append(k)
            size.append(len(part))
    if not wins:
        return ToxicityModel({})
    wins, owner, size = np.array(wins, dtype=np.int32), np.array(owner), np.array(size)
    mask = np.arange(WINDOW) < size[:, None]
    kept = np.zeros(len(docs), dtype=bool)  # kept back
    for y in (0, 1):
        mine = rng.permutation(np.flatnonzero(labels == y))
        kept[mine[: len(mine) // KEPT_BACK]] = True
    judged = kept if min((labels[kept] == y).sum() for y in (0, 1)) >= LEAST_KEPT else np.ones(len(docs), dtype=bool)

    def heights() -> tuple[np.ndarray, np.ndarray]:
        """What the averaged weights say of each window and, by its highest one, of each document."""
        model = ToxicityModel(mean)
        rows = model.projected(types)
        of = np.concatenate([model._logits(rows, wins[k : k + BATCH], mask[k : k + BATCH]) for k in range(0, len(wins), BATCH)])
        top = np.full(len(docs), float(mean["bo"][0]))  # documents without words
        top[owner] = -np.inf
        np.maximum.at(top, owner, of)
        return of, top

    rank = rng.random(len(wins))  # as long as the network knows nothing, any windows will do
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, epoch, best = 0, 0, (-1.0, None, 0.0)
    while epoch < epochs or step < LEAST_STEPS:
        order = np.lexsort((-rank, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        pick = order[place < np.where(labels[owner[order]] == 1, 4 if epoch < EARLY else 3, 3)]
        extra = rng.choice(len(wins), min(len(wins), 400), replace=False)
        pick = rng.permutation(np.concatenate([pick, extra[labels[owner[extra]] == 0]]))
        pick = pick[~kept[owner[pick]]]
        y = labels[owner[pick]]
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        weight = np.sqrt(np.where(y == 1, 0.5 / share, 0.5 / (1 - share))).astype(np.float32)
        target = (y * (1 - 2 * SMOOTH) + SMOOTH).astype(np.float32)
        some = rng.random(len(gids)) >= THINNED
        places = np.concatenate([[0], np.cumsum(some)])[gstart]
        last = max(epochs * -(-len(pick) // STEP), LEAST_STEPS)
        for k in range(0, len(pick), STEP):
            step += 1
            part = pick[k : k + STEP]
            rate = 0.01 * max(0, 1 - step / last) + 0.0005
            _learn(p, moments, step, wins[part], mask[part], target[k : k + STEP], weight[k : k + STEP], wid, gids[some], np.diff(places), places, rate, rng, learned)
            keep = min(0.98, (1 + step) / (10 + step))
            for name, v in mean.items():
                v += (1 - keep) * (p[name] - v)
        epoch += 1
        if epoch >= EARLY:
            rank, top = heights()
            right = ranked_pairs(top[judged], labels[judged])
            if right >= best[0]:
                best = right, {k: v.copy() for k, v in mean.items()}, best_cut(top[judged], labels[judged], weights)
    _, found, cut = best if best[1] is not None else (0, mean, 0.0)
    found["bo"] = (found["bo"] - np.float32(cut)).astype(np.float32)
    return ToxicityModel(found)


def _gradients(p, wins, mask, y, weight, wid, gids, gsizes, gstart, rng):
    """(loss, gradients of the weights, of the word rows and of the character rows) of a batch of windows; rows as (name, ids, gradient)."""
    types, places = np.unique(wins, return_inverse=True)
    places = places.reshape(wins.shape)
    sizes = gsizes[types]
    grams = gids[np.concatenate([np.arange(gstart[w], gstart[w + 1]) for w in types])]
    seen = (rng.random(len(types)) < 0.5).astype(np.float32)[:, None]  # half of the words must do with their characters
    x = np.concatenate([p["word"][wid[types]] * seen, _pool_grams(p["gram"], grams, sizes)], axis=1)
    rows = np.concatenate([x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]], axis=1)
    xp, m = rows[places.T], mask.T
    keep_f, keep_b = [], []
    hf = _gru(xp[:, :, : 3 * HIDDEN], m, p["uf"], keep_f)
    hb = _gru(xp[::-1, :, 3 * HIDDEN :], m[::-1], p["ub"], keep_b)[::-1]
    h = np.concatenate([hf, hb], axis=2)
    th = np.tanh(h @ p["wa"] + p["ba"])
    e = th @ p["va"]
    a = np.exp(e - e.max(0)) * m
    a = a / np.maximum(a.sum(0), 1e-12)
    pooled = (a[:, :, None] * h).sum(0)
    out = _sigmoid(pooled @ p["wo"] + p["bo"])
    loss = -(weight * (y * np.log(out) + (1 - y) * np.log(1 - out))).sum() / len(y)
    d = (out - y) * weight / len(y)
    g = {"wo": pooled.T @ d, "bo": np.array([d.sum()])}
    dpool = d[:, None] * p["wo"]
    da = (h * dpool).sum(2)
    de = a * (da - (a * da).sum(0))
    dth = de[:, :, None] * p["va"] * (1 - th * th)
    g["va"] = (th * de[:, :, None]).sum((0, 1))
    g["wa"], g["ba"] = np.einsum("tbi,tbj->ij", h, dth), dth.sum((0, 1))
    dh = a[:, :, None] * dpool + dth @ p["wa"].T
    dxf, g["uf"] = _gru_back(dh[:, :, :HIDDEN], m, p["uf"], keep_f)
    dxb, g["ub"] = _gru_back(dh[::-1, :, HIDDEN:], m[::-1], p["ub"], keep_b)
    drows = np.zeros((len(types), 6 * HIDDEN), dtype=np.float32)
    flat = places.T.ravel()
    dall = np.concatenate([dxf, dxb[::-1]], axis=2).reshape(-1, 6 * HIDDEN)
    order = np.argsort(flat, kind="stable")
    drows[:] = np.add.reduceat(dall[order], np.searchsorted(flat[order], np.arange(len(types))), axis=0)
    df_, db_ = drows[:, : 3 * HIDDEN], drows[:, 3 * HIDDEN :]
    g["wf"], g["wb"], g["bf"], g["bb"] = x.T @ df_, x.T @ db_, df_.sum(0), db_.sum(0)
    dx = df_ @ p["wf"].T + db_ @ p["wb"].T
    rows = (
        ("word", wid[types], dx[:, :DIM] * seen),
        ("gram", grams, np.repeat(dx[:, DIM:] / np.sqrt(np.maximum(sizes, 1))[:, None], sizes, axis=0)),
    )
    return loss, g, rows


def _learn(p, moments, step, wins, mask, y, weight, wid, gids, gsizes, gstart, rate, rng, learned):
    """One Adam step on a batch of windows."""
    _, g, rows = _gradients(p, wins, mask, y, weight, wid, gids, gsizes, gstart, rng)
    for name, ids, grad in rows:
        ids, grad = ids[learned[name][ids]], grad[learned[name][ids]]
        where, inv = np.unique(ids, return_inverse=True)
        total = np.zeros((len(where), DIM), dtype=np.float32)
        np.add.at(total, inv, grad)
        m1, m2 = moments[name]
        m1[where] = 0.9 * m1[where] + 0.1 * total
        m2[where] = 0.99 * m2[where] + 0.01 * total * total
        p[name][where] -= 0.2 * rate * m1[where] / (np.sqrt(m2[where]) + 1e-6)
    for name, grad in g.items():
        m1, m2 = moments[name]
        m1 += 0.1 * (grad - m1)
        m2 += 0.01 * (grad * grad - m2)
        p[name] -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Collects the bounded sample and fits on the driver."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("_label"))
    )
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).where("_label in (0, 1)").collect()}  # two rows at most
    if len(counts) < 2:
        return ToxicityModel({})
    ones = min(counts[1], TRAIN_DOCS // 3)
    taken = {1: ones, 0: min(counts[0], TRAIN_DOCS - ones)}
    drawn = [known.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(taken[y]) for y in (0, 1)]
    found = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(drawn[0].union(drawn[1])), "_id")
    # An id may repeat in any number of rows: its least text counts, so that the sample stays bounded.
    rows = found.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))
    start = F.pmod(F.xxhash64("_id"), F.greatest(F.lit(1), F.char_length("_text") - TRAIN_TEXT + 1)).cast("int") + 1
    rows = rows.select("_id", F.substring("_text", start, F.lit(TRAIN_TEXT)).alias("_text"), "_label").orderBy("_id").toPandas()
    labels_of = rows["_label"].to_numpy()
    # Labelled ids without a document change nothing: both weights are taken from the labels alone.
    return train_numpy(rows["_text"].to_list(), labels_of, weights=(counts[0] / taken[0], counts[1] / taken[1]))


def scores(docs: DataFrame, model: ToxicityModel, text_col: str = "text"):
    """Column expression: the score of each whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shipped.value.score(texts.to_list()), dtype=float)

    return score(text_of(text_col))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = train(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), scores(docs, model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
