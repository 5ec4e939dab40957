"""Language-model scoring: causal self-attention over subword ids, trained here in numpy.

Model: an embedding of each id and of each pair of neighbouring ids (by a hash), one head of causal
self-attention with a learned bias for each lag and a residual, and two softmaxes: over classes of
ids of like frequency, and over the ids of a class. Their biases are counts of ids over all training
texts; the rest is trained by gradient descent on every training text.

Training: the texts are dealt to shards of about SHARD_IDS ids by a hash, and within a shard sorted,
so the same texts give the same model however the table is partitioned or a task is run again. A
shard descends on its texts of a round from the round's common start; then each row of each
parameter becomes the mean over the shards that used it, weighted by their use of it.

Scoring: texts are cut into overlapping windows of CONTEXT ids, STRIDE apart; each id is scored
once, in the window where it has the longest context, with batched masked attention. The base
score is that of words with add-one counts of the training texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, cut, drop_table, release, text_bytes, word_hashes, word_spans
from .bpe import BLOCK, loaded

#: Ids of a window, ids between windows, width of a context, slots of the table of pairs (by 16 bits).
CONTEXT, STRIDE, WIDTH, PAIRS = 24, 16, 12, 1 << 16
END, VOCABULARY = 50256, 50257
#: Ids of a shard, about; rounds; windows of a step; ids from which windows are shuffled.
SHARD_IDS, ROUNDS, BATCH, MIXED = 8_000_000, 2, 1024, 1 << 20
#: Ids scored at once; rows, and windows in training, whose products are made at once, so that they stay in the cache.
SCORED, ROWS, PART = 1 << 19, 1024, 128
RATE = np.float32(0.2)
#: Shards whose results one task sums; values of a parameter that it holds of each.
FAN_IN, CHUNK = 32, 1 << 16
#: Bytes of text whose words are hashed at once.
WORDS = 1 << 18
#: Most words whose counts are sent to all executors; others are joined by a shuffle.
SENT_WORDS = 1 << 19
MOST = np.float32(60)
_ONES = np.ones(1 << 16, np.float32)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word, A-Z lower-cased; a few texts at a time, whose sums stay in the cache."""
    found, i = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + WORDS, side="right")) - 1)
        low, first, last, text = word_spans(data[at[i] : at[j]], at[i : j + 1] - at[i])
        found.append((word_hashes(low, first, last), text + i))
        i = j
    hashes, texts = zip(*found, strict=True)
    return np.concatenate(hashes), np.concatenate(texts)


class Lookup:
    """Places of hashes among known ones, which are sorted, by buckets of their first bits."""

    def __init__(self, known: np.ndarray):
        self.shift = np.uint64(64 - max(1, len(known).bit_length() + 1))
        edges = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.first = np.append(np.searchsorted(known, edges), len(known)).astype(np.int32)
        self.known = np.append(known, np.uint64(0))  # a place behind the last

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is known."""
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.first.take(bucket), self.first[1:].take(bucket)
        hit = (self.known.take(at) == hashes) & (at < end)
        left = np.flatnonzero(~hit & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit[left] = self.known.take(at.take(left)) == hashes.take(left)
            left = left[~hit.take(left) & (at.take(left) + 1 < end.take(left))]
        return at, hit


def windows(off: np.ndarray, context: int, stride: int):
    """Start, end of the text, text, and whether it is the text's first, of each window."""
    n = np.diff(off)
    count = np.maximum(1, -(-(n - context) // stride) + 1)
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return off[:-1][text] + number * stride, off[1:][text], text, number == 0


def _norm(x: np.ndarray) -> float:
    """The longest row's length."""
    return float(np.sqrt(np.einsum("...i,...i->...", x, x).max(initial=0)))


def _column_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the rows from each edge to the next."""
    return np.add.reduceat(values.view(np.complex64), edges, axis=0).view(np.float32)  # two columns at once; WIDTH is even


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sum of each one's values, and how often it stands there."""
    order = np.argsort(rows, kind="stable")
    r = rows.take(order)
    edges = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    return r[edges], _column_sums(values.take(order, 0), edges), np.diff(np.append(edges, len(r)))


class Attention:
    """Parameters by name (p), their row-wise Adagrad sums (seen) and the layout of ids.

    Ids are numbered by falling count (`rank`); those never seen in training share the number n.
    """

    def __init__(self, counts: np.ndarray, seed: int = 7):
        counts = np.asarray(counts, np.int64)
        ids = np.flatnonzero(counts)
        ids = ids[np.lexsort((ids, -counts[ids]))]
        n = self.n = len(ids)
        self.rank = np.full(len(counts), n, np.uint16)
        self.rank[ids] = np.arange(n)
        self.end = int(self.rank[END]) if len(counts) > END else n
        c = counts[ids].astype(float)
        # classes hold like shares of the root of the counts, so frequent ids have small ones
        share = np.cumsum(np.sqrt(c)) / max(np.sqrt(c).sum(), 1e-9)
        many = max(1, int(np.ceil(0.6 * np.sqrt(n))))
        of = np.unique(np.minimum((np.append(0, share[:-1]) * many).astype(int), many - 1), return_inverse=True)[1] if n else np.zeros(0, int)
        self.classes = (int(of.max()) + 1 if n else 0) + 1  # the last has the ids never seen
        self.class_of = np.append(of, self.classes - 1).astype(np.int64)
        self.edge = np.append(np.searchsorted(of, np.arange(self.classes)), n + 1)
        rest = max(1, len(counts) - n)
        mass = np.append(np.bincount(of, weights=c, minlength=self.classes - 1), 0.1 * rest)
        self.unseen = np.float32(-np.log(rest))
        rng = np.random.default_rng(seed)
        f = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        top, out = np.zeros((self.classes, WIDTH + 1), np.float32), np.zeros((n, WIDTH + 1), np.float32)
        top[:, WIDTH], out[:, WIDTH] = np.log(mass / mass.sum()), np.log(np.maximum(c, 1))
        # the last column of top and out is a bias, as the contexts end in 1
        self.p = {"embed": f(n + 1, WIDTH, by=0.3), "pair": f(PAIRS, WIDTH, by=0.1), "query": f(WIDTH, WIDTH, by=0.25), "key": f(WIDTH, WIDTH, by=0.25), "value": f(WIDTH, WIDTH, by=0.25), "lag": np.zeros((CONTEXT, 1), np.float32), "top": top, "out": out}
        self.seen = {x: np.full(len(v), 1e-6, np.float32) for x, v in self.p.items()}
        self.done = 0  # windows trained on

    def copy(self) -> Attention:
        new = object.__new__(type(self))
        new.__dict__ = {**self.__dict__, "done": 0, "p": {x: v.copy() for x, v in self.p.items()}, "seen": {x: v.copy() for x, v in self.seen.items()}}
        return new

    def stream(self, ranks: np.ndarray, at: np.ndarray):
        """Inputs, targets and pair slots of texts end to end, and their offsets; texts end with END,
        and END is the input before a text's first id."""
        n = np.diff(at) + 1
        off = np.concatenate([[0], np.cumsum(n)])
        first, last = np.zeros(off[-1], bool), np.zeros(off[-1], bool)
        first[off[:-1]], last[off[1:] - 1] = True, True
        given, target = np.full(off[-1], self.end, np.uint16), np.full(off[-1], self.end, np.uint16)
        given[~first], target[~last] = ranks, ranks
        before = np.append(np.uint16(self.end), given[:-1])
        before[first] = self.end
        pair = (given.astype(np.uint32) * np.uint32(40503) + before.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(16)
        return given, target, pair.astype(np.uint16), off

    def weights(self, asks: np.ndarray, across: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Attention of the last cells of each window before it is scaled to a sum of 1, and that scale,
        from their embeddings through query and key, and the embeddings of all cells, as columns. No
        product of both exceeds `most`."""
        n, last, cells = len(asks), asks.shape[1], across.shape[2]
        bias = self.p["lag"][:, 0]
        lag = np.arange(cells - last, cells)[:, None] - np.arange(cells)
        u = asks @ across
        u += np.where(lag >= 0, bias[np.maximum(lag, 0)], np.float32(-1e9)).astype(np.float32)
        if most + float(np.abs(bias).max()) > MOST:
            np.minimum(u, MOST, out=u)
        np.exp(u, out=u)
        return u, 1 / (u.reshape(-1, cells) @ _ONES[:cells]).reshape(n, last, 1)

    def softmaxes(self) -> tuple:
        """For top and for out: rows, biases less the largest (of the class), their exp(), and lengths of rows."""
        ready = []
        for x, edge in (("top", np.zeros(1, np.int64)), ("out", self.edge[: self.classes - 1])):
            rows, bias = np.ascontiguousarray(self.p[x][:, :WIDTH]), self.p[x][:, WIDTH]
            if len(bias):
                bias = bias - np.repeat(np.maximum.reduceat(bias, edge), np.diff(np.append(edge, len(bias))))
            ready += [rows, bias, np.exp(bias), np.sqrt(np.einsum("ij,ij->i", rows, rows))]
        return tuple(ready)

    def softmax(self, h: np.ndarray, y: np.ndarray, grads: bool = False, weight: np.ndarray | None = None, at: np.ndarray | None = None, ready: tuple | None = None):
        """Log probability of each target given its context, the first WIDTH columns of its row of h
        (`at`, if given, tells the row); with grads also the order in which the targets are sorted, and
        the gradients of h in that order, of top and of out (of the log likelihood's negative, each
        target weighted).

        A gradient is the mean of the rows of top (or out) less the target's row. Products are put to
        exp() and summed as they are, the biases weight the sums, and the sums, of few columns, are
        scaled to means instead of the weights.
        """
        top, top_bias, top_weight, top_far, out, out_bias, out_weight, out_far = ready or self.softmaxes()
        n = len(y)
        order = np.argsort(y, kind="stable")
        ys = y.take(order).astype(np.int64)
        hs = h[:, :WIDTH].take(order if at is None else at.take(order), 0)
        edges, edge, sizes = np.searchsorted(ys, self.edge).tolist(), self.edge.tolist(), np.diff(self.edge[: self.classes])
        known, of = edges[self.classes - 1], self.class_of.take(ys)
        longest = _norm(hs)
        clip = longest * float(top_far.max(initial=0)) > MOST
        wide = (longest * np.maximum.reduceat(out_far, self.edge[: self.classes - 1]) > MOST).tolist() if self.n else []
        # what stands in the exponents of the targets
        own, total = top.take(of, 0), top_bias.take(of)
        inside, near = out.take(ys[:known], 0), out_bias.take(ys[:known])
        for c in np.flatnonzero(sizes == 1).tolist():
            inside[edges[c] : edges[c + 1]] = 0  # nothing to tell apart
        if clip:
            raw = np.einsum("ij,ij->i", hs, own)
            total += np.clip(raw, -MOST, MOST) - raw
        for c in np.flatnonzero(wide).tolist():
            raw = np.einsum("ij,ij->i", hs[edges[c] : edges[c + 1]], inside[edges[c] : edges[c + 1]])
            near[edges[c] : edges[c + 1]] += np.clip(raw, -MOST, MOST) - raw
        own[:known] += inside
        total[:known] += near
        total += np.einsum("ij,ij->i", hs, own)
        scale = weight.take(order)[:, None] if weight is not None else None
        mass, inner = np.empty(n, np.float32), np.ones(n, np.float32)
        if grads:
            # contexts as columns, so that scaling them runs along the memory; rows by their weight, with the weight as the last
            columns, means = np.ascontiguousarray(hs.T), np.empty((WIDTH, n), np.float32)
            by = scale[:, 0] if scale is not None else None
            tops, outs = (np.concatenate([x.T * w, w[None]]) for x, w in ((top, top_weight), (out, out_weight)))
            dtop, dout = np.zeros((self.classes, WIDTH + 1), np.float32), np.zeros((self.n, WIDTH + 1), np.float32)

        def summed(rows, sides, a, b, clipped, to):
            """Of the targets from a to b: sums of exp() put in `to`, the means of the rows, and the gradient of the rows."""
            z = rows @ columns[:, a:b]
            if clipped:
                np.clip(z, -MOST, MOST, out=z)
            np.exp(z, out=z)
            sums = sides @ z
            to[a:b] = sums[WIDTH]
            share = 1 / sums[WIDTH]
            mean = sums[:WIDTH]
            mean *= share
            if by is not None:
                share *= by[a:b]
            part = np.empty((WIDTH + 1, b - a), np.float32)
            np.multiply(columns[:, a:b], share, out=part[:WIDTH])
            part[WIDTH] = share
            return mean, z @ part.T

        size = max(ROWS // 4, min(ROWS, (1 << 16) // self.classes))
        for a in range(0, n, size):
            b = min(a + size, n)
            if grads:
                means[:, a:b], more = summed(top, tops, a, b, clip, mass)
                dtop += more
                continue
            z = hs[a:b] @ top.T
            if clip:
                np.clip(z, -MOST, MOST, out=z)
            np.exp(z, out=z)
            np.matmul(z, top_weight, out=mass[a:b])
        for c in range(self.classes - 1):
            a, b, low, high = edges[c], edges[c + 1], edge[c], edge[c + 1]
            if a == b or high - low == 1:
                continue
            if grads:
                more, dout[low:high] = summed(out[low:high], outs[:, low:high], a, b, wide[c], inner)
                means[:, a:b] += more
                continue
            z = hs[a:b] @ out[low:high].T
            if wide[c]:
                np.clip(z, -MOST, MOST, out=z)
            np.exp(z, out=z)
            np.matmul(z, out_weight[low:high], out=inner[a:b])
        total -= np.log(mass)
        total -= np.log(inner)
        total[known:] += self.unseen
        logs = np.empty(n, np.float32)
        logs[order] = total
        if not grads:
            return logs
        ds = np.ascontiguousarray(means.T)
        ds -= own
        if scale is not None:
            ds *= scale
            hs *= scale
        dtop *= top_weight[:, None]
        dout *= out_weight[:, None]
        # contexts of each target, summed
        first = np.flatnonzero(np.append(True, ys[1:] != ys[:-1])[:n])
        if len(first):
            times = np.diff(np.append(first, n)) if scale is None else np.add.reduceat(scale[:, 0], first)
            sums = np.concatenate([_column_sums(hs, first), times[:, None].astype(np.float32)], axis=1)
            r, of = ys[first], of[first]
            start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            dtop[of[start]] -= np.add.reduceat(sums, start, axis=0)
            apart = (r < self.n) & (np.append(sizes, 1)[of] > 1)
            dout[r[apart]] -= sums[apart]
        return logs, order, ds, dtop, dout

    def gradients(self, given, target, pair, start, stop, weight=None):
        """Of the negative log likelihood of windows: name to (rows or None, values, times used)."""
        p = self.p
        cell = start[:, None] + np.arange(CONTEXT)
        real = cell < stop[:, None]
        np.minimum(cell, len(given) - 1, out=cell)
        x, slot = given.take(cell), pair.take(cell)
        e = p["embed"].take(x, 0)
        scale = np.float32(WIDTH**-0.5)
        both = p["query"] @ p["key"].T * scale
        rows = lambda values: values.reshape(-1, WIDTH)
        h, kept = np.empty_like(e), []
        for i in range(0, len(x), PART):
            o = e[i : i + PART]
            asks, across = (rows(o) @ both).reshape(o.shape), np.ascontiguousarray(o.transpose(0, 2, 1))
            u, share = self.weights(asks, across)
            seen = u @ o
            seen *= share
            found = (rows(seen) @ p["value"]).reshape(o.shape)
            np.add(found, o, out=h[i : i + PART])
            h[i : i + PART] += p["pair"].take(slot[i : i + PART], 0)
            kept.append((o, asks, across, u, share, seen, found))
        each = None if weight is None else np.broadcast_to(weight[:, None], real.shape)[real]
        spots = np.flatnonzero(real)
        y = target.take(cell).ravel().take(spots)
        log, order, ds, dtop, dout = self.softmax(rows(h), y, True, each, spots)
        n = len(log)
        spots = spots.take(order)  # as ds is sorted
        place = np.full(x.size, n)  # the row of zeros behind
        place[spots] = np.arange(n)
        rest = (ds if n == x.size else np.concatenate([ds, np.zeros((1, WIDTH), np.float32)])).take(place, 0)
        lag = np.arange(CONTEXT)[:, None] - np.arange(CONTEXT)
        dlags, dboth, dvalue = np.zeros(lag.shape, np.float32), np.zeros((WIDTH, WIDTH), np.float32), np.zeros((WIDTH, WIDTH), np.float32)
        de = rest.reshape(e.shape)  # rest is added to, part by part, once it was read
        for i, (o, asks, across, u, share, seen, found) in zip(range(0, len(x), PART), kept, strict=True):
            d = de[i : i + PART]
            part = d * share
            back = (rows(part) @ p["value"].T).reshape(o.shape)
            du = back @ across
            du -= np.einsum("...i,...i->...", part, found)[..., None]
            du *= u
            dlags += du.sum(0)
            dvalue += rows(seen).T @ rows(d)
            dasks = du @ o
            dboth += rows(o).T @ rows(dasks)
            d += (rows(dasks) @ both.T).reshape(o.shape)
            d += du.transpose(0, 2, 1) @ asks
            d += u.transpose(0, 2, 1) @ back
        dboth *= scale
        dlag = np.bincount(np.maximum(lag, 0).ravel(), weights=np.where(lag >= 0, dlags, 0).ravel(), minlength=CONTEXT)
        every = lambda g: (None, g.astype(np.float32), n)
        grads = {"query": every(dboth @ p["key"]), "key": every(dboth.T @ p["query"]), "value": every(dvalue), "lag": every(dlag[:, None]), "top": every(dtop)}
        # cells that are not real take no part, as the windows of a text end with it: they only follow
        grads["embed"] = _row_sums(x.ravel().take(spots), rows(de).take(spots, 0))
        grads["pair"] = _row_sums(slot.ravel().take(spots), ds)
        grads["out"] = (None, dout, np.bincount(y, minlength=self.n + 1)[: self.n])
        return log, grads

    def step(self, given, target, pair, start, stop, weight=None, used: dict[str, np.ndarray] | None = None) -> float:
        """One step of row-wise Adagrad on a batch of windows; `used` counts the use of each row."""
        log, grads = self.gradients(given, target, pair, start, stop, weight)
        shrink = np.float32(max(1, len(log)) ** -0.5)
        for x, (rows, g, times) in grads.items():
            square = np.einsum("ij,ij->i", g, g) * (shrink * shrink / np.float32(g.shape[1]))
            if rows is None:
                square += self.seen[x]
                self.seen[x] = square
            else:
                square += self.seen[x].take(rows)
                self.seen[x][rows] = square
            g *= (RATE * shrink / (np.sqrt(square) + np.float32(1e-3)))[:, None]
            if rows is None:
                self.p[x] -= g
            else:
                self.p[x][rows] = self.p[x].take(rows, 0) - g
            if used is not None:
                used[x][slice(None) if rows is None else rows] += times
        return float(log.sum())

    def scores(self, ranks: np.ndarray, at: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """Natural log probability of each text with its end."""
        given, target, pair, off = self.stream(ranks, at)
        out = np.zeros(len(at) - 1)
        start, stop, text, whole = windows(off, CONTEXT, STRIDE)
        # what hangs on the id alone is taken from tables
        p, ready = self.p, self.softmaxes()
        queries, values = p["embed"] @ (p["query"] @ p["key"].T * np.float32(WIDTH**-0.5)), p["embed"] @ p["value"]
        most = _norm(queries) * _norm(p["embed"])
        # a text's first window is scored from its start, the others in their last STRIDE cells
        for some, last in ((np.flatnonzero(whole), CONTEXT), (np.flatnonzero(~whole), STRIDE)):
            for i in range(0, len(some), chunk):
                r = some[i : i + chunk]
                cell = start[r][:, None] + np.arange(CONTEXT)
                real = cell[:, CONTEXT - last :] < stop[r][:, None]
                np.minimum(cell, len(given) - 1, out=cell)
                tail, x = cell[:, CONTEXT - last :], given.take(cell).astype(np.int64)
                e, ends = p["embed"].take(x, 0), x[:, CONTEXT - last :]
                u, share = self.weights(queries.take(ends, 0), np.ascontiguousarray(e.transpose(0, 2, 1)), most)
                h = u @ values.take(x, 0)
                h *= share
                h += e[:, CONTEXT - last :]
                h += p["pair"].take(pair.take(tail), 0)
                spots = np.flatnonzero(real)
                log = self.softmax(h.reshape(-1, WIDTH), target.take(tail.ravel().take(spots)), at=spots, ready=ready)
                out += np.bincount(text[r].take(spots // last), weights=log, minlength=len(out))
        return out


def _offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed 16-bit values of a binary column end to end, and the n+1 offsets."""
    each = column.to_pylist()
    return np.frombuffer(b"".join(each), np.uint16), np.cumsum([0, *(len(x) // 2 for x in each)])


def _parts(batch: pa.RecordBatch, most: int = SCORED) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` ids (one row at least)."""
    ends = np.cumsum([len(x) // 2 + 1 for x in batch.column(2).to_pylist()])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _descend(model: Attention, rows: list[tuple[bytes, int]], used: dict[str, np.ndarray]) -> None:
    """Train on the windows of these (ids, copies), in an order that hangs on them alone."""
    ids = model.rank.take(np.frombuffer(b"".join(x for x, _ in rows), np.uint16))
    at = np.concatenate([[0], np.cumsum([len(x) // 2 for x, _ in rows])])
    copies = np.array([c for _, c in rows], np.float32)
    given, target, pair, off = model.stream(ids, at)
    start, stop, text, _ = windows(off, CONTEXT, CONTEXT)
    order = np.random.default_rng(len(start)).permutation(len(start))
    i = 0
    while i < len(order):
        size = min(BATCH, 64 + model.done // 8)  # small steps first
        b = order[i : i + size]
        weight = copies[text[b]]
        model.step(given, target, pair, start[b], stop[b], None if weight.max() == 1 else weight, used)
        i, model.done = i + size, model.done + size


def _round(model: Attention, texts: DataFrame, shards: int) -> None:
    """One round: every shard descends on its texts (shard, k1, k2, ids); rows become weighted means."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(model)
    names = list(model.p)
    sizes = [model.p[x].size for x in names]

    def emit(shard: int, m: Attention, used: dict[str, np.ndarray]):
        """Pieces of the weighted parameters, their Adagrad sums and the weights."""
        weight = [used[x].astype(np.float32) for x in names]
        flat = [(m.p[x] * w[:, None]).ravel() for x, w in zip(names, weight, strict=True)] + [m.seen[x] * w for x, w in zip(names, weight, strict=True)] + weight
        flat = np.concatenate(flat)
        n = -(-len(flat) // CHUNK)
        pieces = [flat[i * CHUNK : (i + 1) * CHUNK].astype(np.float32).tobytes() for i in range(n)]
        yield pa.record_batch([pa.array([shard] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(pieces, pa.binary())], names=["shard", "chunk", "value"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, m, used, held, size, last = None, None, {}, [], 0, None
        for batch in batches:
            for s, a, b, n, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if s != shard:
                    if m is not None:
                        _descend(m, held, used)
                        yield from emit(shard, m, used)
                    shard, m, held, size, last = s, sent.value.copy(), [], 0, None
                    used = {x: np.zeros(len(v)) for x, v in m.p.items()}
                if (a, b) == last:  # equal rows stand together: one text with a weight
                    held[-1] = (held[-1][0], held[-1][1] + n)
                    continue
                if size >= MIXED:
                    _descend(m, held, used)
                    held, size = [], 0
                held.append((ids, n))
                size += len(ids) // 2
                last = (a, b)
        if m is not None:
            _descend(m, held, used)
            yield from emit(shard, m, used)
        release()

    def add(table: pa.Table) -> pa.Table:
        """Sum of one piece over up to FAN_IN shards, in their order."""
        order = np.argsort(table.column("shard").to_numpy(), kind="stable")
        values = table.column("value")
        total = sum(np.frombuffer(values[int(i)].as_py(), np.float32).astype(np.float64) for i in order)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py() // FAN_IN], pa.int64()), "chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "value": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = "shard long, chunk int, value binary"
    parts = max(1, min(shards, 1 << 15))
    dealt = texts.repartition(parts, "shard").sortWithinPartitions("shard", "k1", "k2")
    found = dealt.mapInArrow(descend, schema)
    groups = shards
    while True:
        groups = -(-groups // FAN_IN)
        found = found.groupBy(F.expr(f"shard div {FAN_IN}").alias("group"), "chunk").applyInArrow(add, schema)
        if groups <= 1:
            break
    rows = sorted(found.collect(), key=lambda r: r["chunk"])  # as many values as the model has
    sent.destroy()
    if not rows:
        return
    flat = np.concatenate([np.frombuffer(bytes(r["value"]), np.float32) for r in rows])
    at = np.cumsum([0, *sizes, *(len(model.p[x]) for x in names), *(len(model.p[x]) for x in names)])
    k = len(names)
    for i, x in enumerate(names):
        p, seen, weight = (flat[at[j] : at[j + 1]] for j in (i, i + k, i + 2 * k))
        rows_used = weight > 0
        w = np.maximum(weight, 1)
        model.p[x] = np.where(rows_used[:, None], p.reshape(model.p[x].shape) / w[:, None], model.p[x]).astype(np.float32)
        model.seen[x] = np.where(rows_used, seen / w, model.seen[x]).astype(np.float32)


def train(model: Attention, texts: DataFrame, n_ids: int) -> Attention:
    """The model after training texts (k1, k2, ids): k1 and k2 tell rows apart, ids are packed 16-bit ids."""
    shards = max(1, -(-n_ids // SHARD_IDS))
    keyed = texts.select(F.pmod(F.xxhash64("k1"), F.lit(shards)).alias("shard"), "k1", "k2", F.lit(1).cast("long").alias("n"), "ids", F.pmod(F.col("k1"), F.lit(ROUNDS)).alias("round"))
    for i in range(ROUNDS):
        _round(model, keyed.where(F.col("round") == i).drop("round"), shards)
    return model


def score_texts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    In: doc_id, text; other columns are not read. Null or empty texts have the end alone. A null id
    counts as the empty text in the split. Equal rows have equal scores. With no training text all
    counts are 0 and the model is the smoothed start; no rows give no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text, "doc_id").alias("k2"))

    def encode(batches):
        """Each text's ids (kind 3), and counts of words (kind 0), ids (1) and texts (2) for training."""
        pairs = loaded(ranks_path)
        ids_seen, texts = np.zeros(VOCABULARY, np.int64), 0
        found, held = [], 0

        def merged(parts):
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            return key.view(np.int64), n

        def rows(kind, key, n):
            size = len(key)
            return pa.record_batch([pa.array(np.full(size, kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(size, pa.bool_()), pa.nulls(size, pa.binary())], names=["kind", "k1", "k2", "training", "ids"])

        for block in blocks(batches, BLOCK):
            data, at = text_bytes(block.column(1))
            ids, id_at = pairs.encode(data, at)
            raw = ids.astype("<u2").tobytes()
            pick = np.array([not held_out(d) for d in block.column(0).to_pylist()])
            each = [raw[2 * a : 2 * b] for a, b in zip(id_at[:-1].tolist(), id_at[1:].tolist(), strict=True)]
            yield pa.record_batch([pa.array(np.full(block.num_rows, 3, np.int32)), block.column(2), block.column(3), pa.array(pick), pa.array(each, pa.binary())], names=["kind", "k1", "k2", "training", "ids"])
            if not pick.any():
                continue
            ids_seen += np.bincount(ids[np.repeat(pick, np.diff(id_at))], minlength=VOCABULARY)
            ids_seen[END] += pick.sum()
            texts += int(pick.sum())
            hashes, text = words(data, at)
            found.append(hashes[pick[text]])
            held += len(found[-1])
            if held > 4_000_000:
                yield rows(0, *merged(found))
                found, held = [], 0
        if held:
            yield rows(0, *merged(found))
        if texts:
            used = np.flatnonzero(ids_seen)
            yield rows(1, used, ids_seen[used])
            yield rows(2, np.zeros(1, np.int64), np.array([texts]))

    encoded = cut(docs.select("doc_id", "text", "k1", "k2").mapInArrow(encode, "kind int, k1 long, k2 long, training boolean, ids binary"), "encoded")
    counted = cut(encoded.where("kind < 3").groupBy("kind", F.col("k1").alias("key")).agg(F.sum("k2").alias("n")), "counts")
    ids = np.zeros(VOCABULARY, np.int64)
    texts = 0
    for kind, key, n in counted.where("kind > 0").collect():  # no more rows than the vocabulary has ids
        if kind == 1:
            ids[key] = n
        else:
            texts = n
    table = counted.where("kind = 0").select("key", "n")
    levels = table.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("level")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    train_tokens = sum(r["n"] for r in levels) + texts
    distinct = sum(r["words"] for r in levels) + (1 if texts else 0)
    taken, least = 0, None  # the highest levels whose words fit
    for r in levels:
        if taken + r["words"] > SENT_WORDS:
            break
        taken, least = taken + r["words"], r["level"]
    frequent = table.where(F.floor(F.log2("n") * 4) >= (least if least is not None else 1 << 30)).toArrow()
    keys, n = frequent.column("key").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    order = np.argsort(keys)

    each = encoded.where("kind = 3").select("k1", "k2", "training", "ids")
    model = train(Attention(ids), each.where("training").drop("training"), int(ids.sum()))
    sent = spark.sparkContext.broadcast(model)
    known_words = spark.sparkContext.broadcast((keys[order], np.log10(n[order] + 1.0)))
    end_score = float(np.log10(texts + 1.0))

    def score(batches):
        m = sent.value
        for batch in batches:
            for part in _parts(batch):
                raw, at = _offsets(part.column(2))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(m.scores(m.rank.take(raw), at) / np.log(10))], names=["k1", "k2", "score"])
        release()

    def base(batches):
        known, logs = Lookup(known_words.value[0]), known_words.value[1]
        for block in blocks(batches, BLOCK):
            hashes, text = words(*text_bytes(block.column(1)))
            rows = block.num_rows
            slot, hit = known(hashes)
            total = np.bincount(text[hit], weights=logs[slot[hit]] if hit.any() else None, minlength=rows)[:rows].astype(float)
            rest = np.flatnonzero(~hit)
            edge = np.searchsorted(text[rest], np.arange(rows + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(edge), pa.array(hashes[rest].view(np.int64)))
            split = [held_out(d) for d in block.column(0).to_pylist()]
            yield pa.record_batch([block.column(0), block.column(2), block.column(3), pa.array(split), pa.array(np.bincount(text, minlength=rows) + 1, pa.int64()), pa.array(np.bincount(text[hit], minlength=rows), pa.int64()), pa.array(total), rare], names=["doc_id", "k1", "k2", "held_out", "n_tokens", "hits", "base", "rare"])

    # equal rows once; copies of a row are joined back by the two hashes of its id and text
    values = cut(each.select("k1", "k2", "ids").mapInArrow(score, "k1 long, k2 long, score double"), "scores")
    value = values.groupBy("k1", "k2").agg(F.max("score").alias("score"))
    schema = "doc_id long, k1 long, k2 long, held_out boolean, n_tokens long, hits long, base double, rare array<long>"
    scored = cut(docs.select("doc_id", "text", "k1", "k2").mapInArrow(base, schema).withColumn("row", F.monotonically_increasing_id()), "base")
    rest = scored.select("row", F.explode("rare").alias("key")).join(table, "key", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("more"), F.count("n").alias("found"))
    out = cut(scored.drop("rare").join(rest, "row", "left").join(value, ["k1", "k2"], "left"), "scored")
    sent.destroy()
    known_words.destroy()
    drop_table(encoded, counted, scored, values)
    total = float(np.log10(train_tokens + distinct + 1.0))
    base_score = F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end_score) - F.col("n_tokens") * F.lit(total)
    n_known = F.col("hits") + F.coalesce("found", F.lit(0)) + F.lit(1 if texts else 0)
    return out.select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score")
