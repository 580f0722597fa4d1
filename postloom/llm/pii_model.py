"""Character-level bidirectional LSTM with a CRF on top, in numpy: training and decoding."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Characters with an embedding of their own; all others share one by their class.
ALPHABET = "\n\t abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?'\"()[]{}<>@+-_/\\|&%$#*=~^·äöüßÄÖÜéèêëàâçîïôûùÉÀÇ„“”‚‘’«»–—…"
_CLASSES = ("L", "U", "D", "S", "P", "Z", "C")
_INDEX = {c: i + 1 for i, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET) + 1 + len(_CLASSES)
#: Characters whose scores are held at a time, at most (a longer text is read alone); stretches and characters of a
#: batch of paths; states computed together, which fit a core's cache.
PIECE, BATCH, CELLS, BLOCK = 3_000_000, 1024, 50_000, 640


def _other(c: str) -> int:
    k = unicodedata.category(c)
    name = "U" if k == "Lu" else "L" if k[0] in "LM" else "D" if k[0] == "N" else k[0]
    return len(ALPHABET) + 1 + _CLASSES.index(name)


def encode(text: str) -> np.ndarray:
    """Numbers of the characters; 0 is padding."""
    return _TABLE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


#: Number of every code point (one row for each class of characters outside the alphabet), two bytes each.
_TABLE = np.full(0x110000, len(ALPHABET) + 1 + _CLASSES.index("C"), np.int16)
for _c in range(0x30000):
    _TABLE[_c] = _INDEX.get(chr(_c)) or _other(chr(_c))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Weights: E (characters), per direction Wx, Wh, b (gates i, f, o, g), output Wo, bo, transitions A, start s."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    @staticmethod
    def fresh(hidden: int = 32, embed: int = 16, seed: int = 11) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {"E": rng.normal(0, 0.3, (SIZE, embed)), "Wo": rng.normal(0, 0.15, (2 * hidden, len(TAGS))), "bo": np.zeros(len(TAGS)), "A": np.zeros((len(TAGS), len(TAGS))), "s": np.zeros(len(TAGS))}
        for d in "fb":
            w[f"Wx{d}"] = rng.normal(0, 1 / np.sqrt(embed), (embed, 4 * hidden))
            w[f"Wh{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            w[f"b{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        return Tagger(w)

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, tuple | None]:
        """x: time, batch, embed -> outputs; keep: also what the way back needs."""
        t, n, _ = x.shape
        wh = self.w[f"Wh{d}"]
        k = wh.shape[0]
        pre = (x.reshape(t * n, -1) @ self.w[f"Wx{d}"] + self.w[f"b{d}"]).reshape(t, n, 4 * k)
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out = np.empty((t, n, k), np.float32)
        gates, cells = (np.empty((t, n, 4 * k), np.float32), np.empty((t, n, k), np.float32)) if keep else (None, None)
        for i in range(t):
            z = pre[i] + h @ wh
            z[:, : 3 * k] = _sigmoid(z[:, : 3 * k])
            z[:, 3 * k :] = np.tanh(z[:, 3 * k :])
            c = z[:, k : 2 * k] * c + z[:, :k] * z[:, 3 * k :]
            h = z[:, 2 * k : 3 * k] * np.tanh(c)
            out[i] = h
            if keep:
                gates[i], cells[i] = z, c
        return out, (x, gates, cells, out) if keep else None

    def _back(self, dout: np.ndarray, saved: tuple, d: str, grad: dict[str, np.ndarray]) -> np.ndarray:
        x, gates, cells, out = saved
        t, n, k = out.shape
        wh = self.w[f"Wh{d}"]
        dz = np.empty_like(gates)
        dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        for i in range(t - 1, -1, -1):
            z, c = gates[i], cells[i]
            prev = cells[i - 1] if i else np.zeros_like(c)
            g = dout[i] + dh
            tc = np.tanh(c)
            dc = dc + g * z[:, 2 * k : 3 * k] * (1 - tc * tc)
            dz[i, :, :k] = dc * z[:, 3 * k :] * z[:, :k] * (1 - z[:, :k])
            dz[i, :, k : 2 * k] = dc * prev * z[:, k : 2 * k] * (1 - z[:, k : 2 * k])
            dz[i, :, 2 * k : 3 * k] = g * tc * z[:, 2 * k : 3 * k] * (1 - z[:, 2 * k : 3 * k])
            dz[i, :, 3 * k :] = dc * z[:, :k] * (1 - z[:, 3 * k :] ** 2)
            dc = dc * z[:, k : 2 * k]
            dh = dz[i] @ wh.T
        flat = dz.reshape(t * n, 4 * k)
        before = np.concatenate([np.zeros((1, n, k), np.float32), out[:-1]])
        grad[f"Wh{d}"] = before.reshape(t * n, k).T @ flat
        grad[f"Wx{d}"] = x.reshape(t * n, -1).T @ flat
        grad[f"b{d}"] = flat.sum(0)
        return (flat @ self.w[f"Wx{d}"].T).reshape(x.shape)

    def emissions(self, ids: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
        """ids: batch, time -> scores: time, batch, tags."""
        n, t = ids.shape
        place = np.arange(t)[None]
        turn = np.where(place < lengths[:, None], lengths[:, None] - 1 - place, place)  # each text reversed in itself
        e = self.w["E"][ids.T]
        r = np.take_along_axis(ids, turn, 1)
        f, sf = self._run(e, "f", keep)
        b, sb = self._run(self.w["E"][r.T], "b", keep)
        back = np.take_along_axis(b, turn.T[:, :, None], 0)
        both = np.concatenate([f, back], 2)
        out = both @ self.w["Wo"] + self.w["bo"]
        return out, (both, sf, sb, turn, ids, r) if keep else None

    def loss(self, ids: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood a character, and its gradients; tags: batch, time."""
        w = self.w
        em, (both, sf, sb, turn, _, r) = self.emissions(ids, lengths, True)
        em = em.astype(np.float64)
        t, n, k = em.shape
        a = w["A"].astype(np.float64)
        live = np.arange(t)[:, None] < lengths[None]
        alpha = np.empty((t, n, k))
        alpha[0] = em[0] + w["s"]
        for i in range(1, t):
            m = alpha[i - 1].max(1, keepdims=True)
            nxt = np.log(np.exp(alpha[i - 1] - m) @ np.exp(a)) + m + em[i]
            alpha[i] = np.where(live[i][:, None], nxt, alpha[i - 1])
        top = alpha[-1].max(1, keepdims=True)
        logz = (np.log(np.exp(alpha[-1] - top).sum(1, keepdims=True)) + top)[:, 0]
        beta = np.zeros((t, n, k))
        da = np.zeros((k, k))
        expa = np.exp(a)
        for i in range(t - 2, -1, -1):
            v = beta[i + 1] + em[i + 1]
            m = v.max(1, keepdims=True)
            ev = np.exp(v - m)
            nxt = np.log(ev @ expa.T) + m
            on = live[i + 1][:, None]
            beta[i] = np.where(on, nxt, 0.0)
            left = np.exp(alpha[i] + m - logz[:, None]) * on
            da += expa * (left.T @ ev)
        post = np.exp(alpha + beta - logz[None, :, None]) * live[:, :, None]
        gold = tags.T
        rows = np.arange(n)
        score = (np.take_along_axis(em, gold[:, :, None], 2)[:, :, 0] * live).sum() + w["s"][gold[0]].sum()
        steps = live[1:]
        score += (a[gold[:-1], gold[1:]] * steps).sum()
        dem = post
        np.add.at(dem, (np.repeat(np.arange(t), n), np.tile(rows, t), gold.ravel()), -live.ravel().astype(float))
        np.add.at(da, (gold[:-1][steps], gold[1:][steps]), -1.0)
        total = float(lengths.sum())
        dem = (dem / total).astype(np.float32)
        grad = {"A": (da / total).astype(np.float32), "s": dem[0].sum(0), "bo": dem.sum((0, 1)), "Wo": both.reshape(t * n, -1).T @ dem.reshape(t * n, k)}
        dboth = dem @ w["Wo"].T
        h = w["Whf"].shape[0]
        df = self._back(np.ascontiguousarray(dboth[:, :, :h]), sf, "f", grad)
        db = self._back(np.take_along_axis(dboth[:, :, h:], turn.T[:, :, None], 0), sb, "b", grad)
        de = np.zeros_like(w["E"])
        np.add.at(de, ids.T.ravel(), df.reshape(t * n, -1))
        np.add.at(de, r.T.ravel(), db.reshape(t * n, -1))
        grad["E"] = de
        return float((logz.sum() - score) / total), grad

    def _fast(self) -> tuple[np.ndarray, ...]:
        """By direction and gate: a row for each character, and the weights of the state; by direction, those of the tags.

        Scaled so that 1 / (1 + exp(z)) is each gate, with g as (1 - its tanh) / 2.  Tags are scored against O.
        """
        if not hasattr(self, "_ready"):
            w, k = self.w, self.w["Whf"].shape[0]
            scale = np.concatenate([np.full(3 * k, -1, np.float32), np.full(k, 2, np.float32)])

            def gates(x: np.ndarray) -> np.ndarray:
                return (x * scale).reshape(len(x), 4, k).transpose(1, 0, 2)

            pre = np.stack([gates(w["E"] @ w[f"Wx{d}"] + w[f"b{d}"]) for d in "fb"])
            wh = np.stack([gates(w[f"Wh{d}"]) for d in "fb"])
            wo = (w["Wo"][:, 1:] - w["Wo"][:, :1]).reshape(2, k, -1)
            self._ready = tuple(np.ascontiguousarray(x, np.float32) for x in (pre, wh, wo))
        return self._ready

    def _bounds(self) -> tuple[np.ndarray, np.ndarray, float, float]:
        """What a span may gain at most over O, besides the scores of its characters: for each tag when it goes on with
        the tag and when it begins with it; for a beginning that begins the text, and for an end that ends it.

        Each tag gets a potential, taken when it is entered and given back when it is left, so that the price of leaving
        is counted with the entry and going on is worth little.  The bounds hold for any potentials.
        """
        a, s = self.w["A"].astype(float), self.w["s"].astype(float)
        gain = a - a[0, 0]
        step = max(0.0, float(np.diag(gain)[1:].max())) + 0.01
        worth = gain[1:, 0].copy()
        for _ in range(len(a)):
            worth = np.maximum(worth, (gain[1:, 1:] - step + worth).max(1))
        leave = max(0.0, float((gain[1:, 0] - worth).max()))
        on = (gain[1:, 1:] - worth[:, None] + worth).max(0)
        return on, gain[0, 1:] + worth + leave, max(0.0, float((s[1:] - s[0] - gain[0, 1:]).max())), max(0.0, float(-worth.min()))

    def _beginnings(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lane: int, tops: list[tuple[slice, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One direction: a row of scores for each distinct beginning, the row of each character, and of each beginning
        the highest score among some tags, with what each is given besides (tops).

        chars: the texts one after the other.  What is known of a text up to a character depends on nothing behind it,
        so a beginning that several texts share is read once.
        """
        pre, wh, wo = (x[lane] for x in self._fast())
        k = wh.shape[1]
        flat = chars.tobytes()
        keys = [flat[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        starts, lengths = starts[order], lengths[order]
        scores, top = self._room(lane, len(chars), wo.shape[1], len(tops))
        row = np.empty(len(chars), np.int32)
        zs, vs, hs, us = (np.empty((w * BLOCK, k), np.float32) for w in (4, 4, 1, 1))
        h, before, c, state = np.zeros((4, len(order), k), np.float32)
        live, node, same = np.arange(len(order)), np.zeros(len(order), np.int64), np.ones(len(order), bool)
        total = 0
        for i in range(int(lengths.max())):
            on = lengths[live] > i
            if not on.all():
                live, node, same = live[on], node[on], same[on]
            at = starts[live] + i
            char = chars[at]
            # sorted texts share a beginning with the one before them, or with none
            same[1:] &= (char[1:] == char[:-1]) & (live[1:] - live[:-1] == 1)
            same[0] = False
            fresh = np.flatnonzero(~same)
            parent, char = node[fresh], char[fresh].astype(np.int64)
            node = np.cumsum(~same) - 1
            row[at] = node + total
            h, before, c, state = before, h, state, c
            for a in range(0, len(fresh), BLOCK):
                some = slice(a, min(a + BLOCK, len(fresh)))
                m = some.stop - a
                z, v, u, cell = zs[: 4 * m].reshape(4, m, k), vs[: 4 * m].reshape(4, m, k), us[:m], c[some]
                np.take(before, parent[some], axis=0, out=hs[:m], mode="clip")
                np.take(state, parent[some], axis=0, out=cell, mode="clip")
                np.take(pre, char[some], axis=1, out=v, mode="clip")
                np.matmul(hs[:m], wh, out=z)
                z += v
                np.exp(z, out=z)
                z += 1
                np.divide(1, z, out=z)
                i_, f_, o_, g_ = z
                g_ *= 4
                g_ -= 2
                g_ *= i_
                cell *= f_
                cell += g_  # the state times -2, as its tanh takes it
                np.exp(cell, out=u)
                u += 1
                np.divide(2, u, out=u)
                u -= 1
                np.multiply(o_, u, out=h[some])
            for a in range(0, len(fresh), 8 * BLOCK):
                some = slice(a, min(a + 8 * BLOCK, len(fresh)))
                here = slice(total + a, total + some.stop)
                tags = np.ascontiguousarray(np.matmul(h[some], wo, out=scores[here]).T)
                for j, (which, extra) in enumerate(tops):
                    np.maximum.reduce(tags[which] if extra is None else tags[which] + extra, axis=0, out=top[j, here])
            total += len(fresh)
        return scores[:total], row, top[:, :total]

    def _room(self, lane: int, size: int, tags: int, tops: int) -> tuple[np.ndarray, np.ndarray]:
        """Memory for scores, kept for the next piece: touching new memory costs as much as computing what goes there."""
        rooms = self.__dict__.setdefault("_rooms", {})
        if lane not in rooms or len(rooms[lane][0]) < size:
            rooms[lane] = None
            rooms[lane] = np.empty((max(size, PIECE), tags), np.float32), np.empty((tops, max(size, PIECE)), np.float32)
        return rooms[lane]

    def _scores(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """The scores of emissions against O in two parts, whose sum is wanted, and where some tag could be on the best path.

        Rows of scores forth and the row of each character, the same back, and a mark for each character: False
        where every span over it would have a lower score than O in its place, whatever is beside it.
        """
        on, begin, at_start, at_end = self._bounds()
        bias = self.w["bo"][1:] - self.w["bo"][0]
        lengths = np.array([len(t) for t in texts])
        chars = encode("".join(texts)).astype(np.uint8)
        starts = np.cumsum(lengths) - lengths
        every, opening, inner = slice(None), slice(0, None, 2), slice(1, None, 2)
        go, enter = ((bias + x).astype(np.float32)[:, None] for x in (on, begin))
        with np.errstate(over="ignore"):  # of exp: the gate is 0 then
            forth, f, ft = self._beginnings(chars, starts, lengths, 0, [(every, go), (opening, enter[opening]), (inner, enter[inner])])
            back, b, bt = self._beginnings(chars[::-1], len(chars) - starts - lengths, lengths, 1, [(every, None), (opening, None)])
        b = b[::-1]
        rest = bt[0][b]
        goes = (ft[0][f] + rest).astype(float)
        begins = np.maximum(ft[1][f] + bt[1][b], ft[2][f] + rest).astype(float)
        last = starts + lengths - 1
        begins[starts] += at_start
        begins[last] += at_end
        goes[last] += at_end
        # the best span over a character: the highest sum from it on, without the lowest before a beginning up to it;
        # between texts the sum falls by more than spans of two of them could gain
        goes[starts[1:]] -= 2 * np.add.reduceat(np.maximum(goes, 0), starts).max() + np.maximum(begins, 0).max() + 1
        total = np.cumsum(goes)
        best = np.maximum.accumulate(total[::-1])[::-1] - np.minimum.accumulate(total - begins)
        return forth, f, back, b, best > -0.01  # far more than rounding makes

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each text by the best path.

        The path is searched only over stretches that could hold anything but O; O stands on both sides of them.
        """
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        a, s, bias = self.w["A"], self.w["s"], self.w["bo"][1:] - self.w["bo"][0]
        for piece in _pieces(texts):
            forth, f, back, b, may = self._scores([texts[i] for i in piece])
            ends = np.cumsum([len(texts[i]) for i in piece])
            starts = np.append(0, ends[:-1])
            opens, closes = may.copy(), may.copy()
            opens[1:] &= ~may[:-1]
            opens[starts] = may[starts]
            closes[:-1] &= ~may[1:]
            closes[ends - 1] = may[ends - 1]
            opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            order = np.argsort(closes - opens, kind="stable")
            at = 0
            while at < len(order):
                some = order[at : at + BATCH]
                x, lengths = opens[some], (closes - opens)[some]
                most = max(1, CELLS // int(lengths[-1]))
                some, x, lengths = some[:most], x[:most], lengths[:most]
                at += len(some)
                cell = x + np.minimum(np.arange(int(lengths[-1]))[:, None], lengths - 1)
                em = np.take(forth, f[cell], axis=0)
                em += np.take(back, b[cell], axis=0)
                em += bias
                text = np.searchsorted(starts, x, "right") - 1
                before = np.where(x == starts[text], s[:, None], a[0][:, None])
                after = np.where(closes[some] == ends[text], np.float32(0), a[:, 0][:, None])
                place = list(zip((x - starts[text]).tolist(), text.tolist()))
                for r, y, z, k in _all_spans(self._paths(em, lengths, before, after)):
                    p, t = place[r]
                    out[piece[t]].append((p + y, p + z, k))
        for found in out:
            found.sort()
        return out

    def _paths(self, em: np.ndarray, lengths: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """em: time, stretches, tags but O (whose scores are 0); before, after: what each tag gets at the beginning and end.

        Returns the tags: time, stretches; O behind the end.
        """
        t, n, _ = em.shape
        em = np.ascontiguousarray(em.transpose(0, 2, 1))  # tags before texts: every step works on long rows
        a = self.w["A"]
        k = len(a)
        columns = [np.ascontiguousarray(a[j][:, None]) for j in range(k)]
        best = np.empty((t, k, n), np.float32)
        best[0] = before
        best[0, 1:] += em[0]
        cand = np.empty((k, n), np.float32)
        for i in range(1, t):
            prev, top = best[i - 1], best[i]
            np.add(prev[0], columns[0], out=top)
            for j in range(1, k):
                np.add(prev[j], columns[j], out=cand)
                np.maximum(top, cand, out=top)
            top[1:] += em[i]
        path = np.zeros((t, n), np.int8)
        state = (best[lengths - 1, :, np.arange(n)] + after.T).argmax(1)
        for i in range(t - 1, 0, -1):
            inside = i < lengths
            path[i] = np.where(inside, state, 0)
            state = np.where(inside, (best[i - 1] + a[:, state]).argmax(0), state)
        path[0] = state
        return path


def _pieces(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of the texts that are not empty, in pieces of at most PIECE characters or one text."""
    piece: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if piece and size + len(t) > PIECE:
            yield piece
            piece, size = [], 0
        if t:
            piece.append(i)
            size += len(t)
    if piece:
        yield piece


def _all_spans(path: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
    """The column and the span of each of spans() of every column."""
    tags = np.zeros((path.shape[1], len(path) + 2), np.int8)
    tags[:, 1:-1] = path.T
    kinds = (tags + 1) // 2
    other = kinds[:, 1:] != kinds[:, :-1]
    starts = (kinds[:, 1:] > 0) & (other | (tags[:, 1:] % 2 == 1))
    ends = (kinds[:, :-1] > 0) & (other | starts)
    (r, a), (_, b) = np.nonzero(starts), np.nonzero(ends)
    for i, x, y, k in zip(r.tolist(), a.tolist(), b.tolist(), kinds[r, a + 1].tolist()):
        yield i, x, y, KINDS[k - 1]


def spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Maximal spans of a tag sequence; an inner tag without beginning opens one."""
    out, start, kind = [], -1, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        k, begins = ((t - 1) // 2, (t - 1) % 2 == 0) if t else (-1, False)
        if start >= 0 and (k != kind or begins):
            out.append((start, i, KINDS[kind]))
            start = -1
        if k >= 0 and start < 0:
            start, kind = i, k
    return out
