"""Orders of items of few kinds with a great sum of similarities of neighbours: greedy, then two-opt until no reversal is better.

Neighbours of one kind are kept as one run. An edge is compared with all others once, in both directions; later only with new
ones and with those that would gain if one of the two were turned. Every step is the one that comparing all pairs of all items
each time would take.
"""

from __future__ import annotations

import numpy as np

from parchmill.functions.similarity import lcs_length

#: A reversal must gain more than this.
LEAST = 1e-12
#: Bytes of lengths of common subsequences that are kept; beyond them they are computed each time.
HELD = 500_000_000


class Matrix:
    """Values of pairs of kinds, given as a symmetric matrix."""

    def __init__(self, s: np.ndarray):
        self.s, self.size, self.top = s, len(s), float(s.max())

    def row(self, k: int) -> np.ndarray:
        return self.s[k]

    def some(self, k: int, ks: np.ndarray) -> np.ndarray:
        return self.s[k, ks]

    def one(self, a: int, b: int) -> float:
        return float(self.s[a, b])


class Words:
    """2 LCS / (m + n) of distinct words, a word against all at once: their tables are the bits of integers."""

    def __init__(self, words: list[str], sign: int = 1):
        self.words, self.sign, self.size, self.top = words, sign, len(words), max(0.0, float(sign))
        self.n = np.array([len(w) for w in words], np.int64)
        kind = np.uint32 if self.n.max(initial=0) <= 32 else np.uint64
        self.long = np.flatnonzero(self.n > 64)
        at: dict[str, dict[int, int]] = {}
        for j, w in enumerate(words):
            for i, c in enumerate(w if len(w) <= 64 else ""):
                x = at.setdefault(c, {})
                x[j] = x.get(j, 0) | 1 << i
        self.masks = {}
        for c, x in at.items():
            where, bits = np.fromiter(x, np.int64, len(x)), np.fromiter(x.values(), kind, len(x))
            if 4 * len(x) > len(words):  # a frequent letter: bits of all words, else of those that have it
                every = np.zeros(len(words), kind)
                every[where] = bits
                where, bits = slice(None), every
            self.masks[c] = where, bits
        self.full = np.array([(1 << len(w)) - 1 if len(w) <= 64 else 0 for w in words], kind)
        self.type = np.uint8 if self.n.max(initial=0) < 256 else np.int32
        self.kept: dict[int, np.ndarray] = {}
        self.room = HELD // (len(words) * np.dtype(self.type).itemsize + 200)

    def lengths(self, k: int) -> np.ndarray:
        out = self.kept.get(k)
        if out is None:
            v = self.full.copy()
            for c in self.words[k]:
                if c in self.masks:
                    where, bits = self.masks[c]
                    x = v[where]
                    u = x & bits
                    v[where] = ((x + u) | (x - u)) & self.full[where]
            out = (self.n - np.bitwise_count(v)).astype(self.type)
            for j in self.long:
                out[j] = lcs_length(self.words[k], self.words[j])
            if len(self.kept) < self.room:
                self.kept[k] = out
        return out

    def row(self, k: int) -> np.ndarray:
        return self.sign * 2.0 * self.lengths(k) / (self.n + self.n[k])

    def some(self, k: int, ks: np.ndarray) -> np.ndarray:
        if len(ks) <= 16 and k not in self.kept:
            found = np.array([lcs_length(self.words[k], self.words[j]) for j in ks.tolist()], np.int64)
        else:
            found = self.lengths(k)[ks]
        return self.sign * 2.0 * found / (self.n[ks] + self.n[k])

    def one(self, a: int, b: int) -> float:
        x = self.kept.get(a)
        return self.sign * 2.0 * int(lcs_length(self.words[a], self.words[b]) if x is None else x[b]) / (len(self.words[a]) + len(self.words[b]))


def greedy(w, kind: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From an item always to the first of the best that are left: kinds and lengths of the runs, and the values between them."""
    n = len(kind)
    items, counts = np.argsort(kind, kind="stable"), np.bincount(kind, minlength=w.size)
    end = np.cumsum(counts)
    at = end - counts  # of each kind the place of its first item that is left
    k = int(kind[start])
    i = at[k] + int(np.searchsorted(items[at[k] : end[k]], start))
    items[at[k] + 1 : i + 1] = items[at[k] : i].copy()
    at[k] += 1
    left = at < end
    first = np.where(left, items[np.minimum(at, n - 1)], n)
    ks, cs, es, rest = [k], [1], [], n - 1
    while rest:
        row = np.where(left, w.row(k), -np.inf)
        best = row.max()
        ties = np.flatnonzero(row == best)
        q = int(ties[first[ties].argmin()])
        m = int(end[q] - at[q]) if q == k and len(ties) == 1 else 1
        if q == k:
            cs[-1] += m
        else:
            ks.append(q), cs.append(m), es.append(best)
        at[q] += m
        rest -= m
        left[q] = at[q] < end[q]
        first[q] = items[at[q]] if left[q] else n
        k = q
    return np.array(ks), np.array(cs), np.array(es, float)


class Chain:
    """Runs of items, with what is known of pairs of the edges between them."""

    def __init__(self, w, own: np.ndarray, several: np.ndarray, k: np.ndarray, c: np.ndarray, e: np.ndarray):
        self.w, self.own, self.several, self.k, self.c, self.e = w, own, several, k, c, e
        self.flat = bool((own == w.top).all())  # no pair is better than two items of a kind
        self.first = len(e)  # edges with a lower number are the greedy ones
        self.ids = np.arange(len(e))
        self.at = np.arange(len(e) + 1024)  # place of an edge, -1 without
        self.calm = np.zeros(len(e) + 1024, bool)  # edges that no run of a kind can be cut for
        self.seen = [False] * len(e)  # edges that were compared with all others
        self.fresh: set[int] = set()  # new edges that were not
        self.ends = [-1] * len(e)  # the change of the last item for which the edge is known to gain nothing
        self.last, self.swept = 0, False
        self.turned: dict[int, set[int]] = {}  # pairs that gain if one of them is turned
        self.places()

    def places(self) -> None:
        self.at[self.ids] = np.arange(len(self.ids))
        self.low = self.many = self.ahead = self.lively = None

    def edge(self) -> int:
        i = len(self.seen)
        if i >= len(self.at):
            self.at, self.calm = np.concatenate([self.at, np.full(i, -1)]), np.concatenate([self.calm, np.zeros(i, bool)])
        self.fresh.add(i)
        self.seen.append(False)
        self.ends.append(-1)
        return i

    def gone(self, i: int) -> None:
        i = int(i)
        self.at[i] = -1
        self.fresh.discard(i)
        for j in self.turned.pop(i, ()):
            self.turned[j].discard(i)

    def one(self, a: int, b: int) -> float:
        return self.w.one(a, b)

    def known(self, a: int, js: np.ndarray) -> None:
        if len(js):
            js = js.tolist()
            self.turned.setdefault(a, set()).update(js)
            for j in js:
                self.turned.setdefault(j, set()).add(a)

    def best(self, x: int, inner: bool) -> tuple[float, int, bool]:
        """Greatest gain of reversing from run ``x`` (its second item if ``inner``), the last run of that, whether of this only one item."""
        w, k, c, e, n = self.w, self.k, self.c, self.e, len(self.k)
        if self.many is None:
            self.many = np.flatnonzero(c >= 2)
        h, many = int(k[x]), self.many[np.searchsorted(self.many, x) :]
        if not x and not inner:
            g = np.append(w.row(h)[k[1:]] - e, 0.0)
            cut = w.some(h, k[many]) - self.own[k[many]]
            return self.pick(g, np.arange(n), cut, many)
        p = h if inner else int(k[x - 1])
        edge = float(self.own[h] if inner else e[x - 1])
        a = -1 if inner else int(self.ids[x - 1])
        new = not inner and not self.seen[a]
        ys = None  # all
        if inner:
            if self.lively is None:
                self.lively = np.flatnonzero(~self.calm[self.ids])
            ys = self.lively[np.searchsorted(self.lively, x) :]
            if not len(ys) and self.flat:
                return 0.0, -1, False
            many = many[:0] if self.flat else many
        elif not new:
            if self.ahead is None:
                self.ahead = np.unique(self.at[list(self.fresh)]) if self.fresh else np.zeros(0, np.int64)
            ys = self.ahead[np.searchsorted(self.ahead, x) :] if len(self.ahead) else self.ahead
            if a in self.turned:
                ys = np.unique(np.append(ys, self.at[list(self.turned[a])]))
                ys = ys[ys >= x]
            if not len(ys) and self.ends[a] == self.last and (self.calm[a] or not len(many)):
                return 0.0, -1, False
        elif edge == w.top:  # only pairs with an edge that could be better
            if self.low is None:
                self.low = np.flatnonzero(e < w.top)
            ys = self.low[np.searchsorted(self.low, x) :]
        if ys is None:
            rp, rh = w.row(p), w.row(h)
            fp, fh, ex = rp[k[x:]], rh[k[x:]], e[x:]
            q1, r1, q2, r2 = fp[:-1], fh[1:], fh[:-1], fp[1:]
            g = np.append((q1 - edge) + (r1 - ex), fp[-1] - edge)
            out = lambda: np.arange(x, n)
        else:
            q1, r1, ex = w.some(p, k[ys]), w.some(h, k[ys + 1]), e[ys]
            g = np.append((q1 - edge) + (r1 - ex), self.one(p, int(k[-1])) - edge)
            out = lambda: np.append(ys, n - 1)
        cut = np.zeros(0)
        if len(many) and (inner or not self.calm[a]):
            cut = (w.some(p, k[many]) - edge) + (w.some(h, k[many]) - self.own[k[many]])
        found = self.pick(g, out, cut, many)
        if found[0] > LEAST or inner:
            return found
        # Nothing gains: pairs that would with one of them turned are kept for later.
        if ys is None:
            js = x + np.flatnonzero((r2 - edge) + (q2 - ex) > LEAST / 2)
        elif len(ys):
            js = ys[(w.some(p, k[ys + 1]) - edge) + (w.some(h, k[ys]) - ex) > LEAST / 2]
        else:
            js = ys
        self.known(a, self.ids[js])
        if new:
            self.compare(x - 1, x - 1 if a >= self.first else 0)  # those before were compared when this one was not there
        if max(self.one(p, int(k[-1])), self.one(h, int(k[-1]))) - edge <= LEAST / 2:
            self.ends[a] = self.last
        return found

    def compare(self, z: int, n: int) -> None:
        """Edge ``z`` with the first ``n`` edges, either of the two turned or not, and with the cuts of runs."""
        w, k, p, h, a, edge, m = self.w, self.k, int(self.k[z]), int(self.k[z + 1]), int(self.ids[z]), float(self.e[z]), self.several
        ys = np.arange(n) if edge < w.top else np.flatnonzero(self.e[:n] < w.top)
        if len(ys):
            q, r, ex = k[ys], k[ys + 1], self.e[ys]
            gains = np.maximum((w.some(p, q) - edge) + (w.some(h, r) - ex), (w.some(p, r) - edge) + (w.some(h, q) - ex))
            self.known(a, self.ids[ys[(gains > LEAST / 2) & (ys != z)]])
        self.calm[a] = not len(m) or ((w.some(p, m) - edge) + (w.some(h, m) - self.own[m])).max() <= LEAST / 2
        self.seen[a] = True
        self.ahead = self.lively = None
        self.fresh.discard(a)

    def pick(self, g: np.ndarray, places, cut: np.ndarray, many: np.ndarray) -> tuple[float, int, bool]:
        """The first of the greatest; the cut behind the first item of a run lies before its end."""
        j = int(g.argmax())
        gain, i = g[j], int(cut.argmax()) if len(cut) else -1
        if i < 0 and gain <= LEAST:
            return 0.0, -1, False
        y = int((places() if callable(places) else places)[j])
        if i >= 0 and (cut[i] > gain or cut[i] == gain and many[i] <= y):
            return float(cut[i]), int(many[i]), True
        return float(gain), y, False

    def reverse(self, x: int, y: int, cut: bool) -> None:
        """Reverse runs ``x`` to ``y``, of ``y`` only the first item if ``cut``."""
        k, c, e, ids = self.k, self.c, self.e, self.ids
        h, q = int(k[x]), int(k[y])
        self.last += y + 1 == len(k)
        if x:
            self.gone(ids[x - 1])
            e[x - 1], ids[x - 1] = self.one(int(k[x - 1]), q), self.edge()
        if cut:
            self.k = k = np.concatenate([k[:x], [q], k[x:y][::-1], k[y:]])
            self.c = c = np.concatenate([c[:x], [1], c[x:y][::-1], c[y:]])
            c[y + 1] -= 1
            self.e = e = np.concatenate([e[:x], e[x:y][::-1], [self.one(h, q)], e[y:]])
            self.ids = ids = np.concatenate([ids[:x], ids[x:y][::-1], [self.edge()], ids[y:]])
        else:
            for z in (k, c):
                z[x : y + 1] = z[x : y + 1][::-1].copy()
            for z in (e, ids):
                z[x:y] = z[x:y][::-1].copy()
            if y + 1 < len(k):
                self.gone(ids[y])
                e[y], ids[y] = self.one(h, int(k[y + 1])), self.edge()
        if y + 1 < len(k) and k[y] == k[y + 1]:
            c[y + 1] += c[y]
            self.gone(ids[y])
            self.k, self.c, self.e, self.ids = (np.delete(z, y) for z in (k, c, e, ids))
        self.places()
        if self.swept:  # all edges but the new ones are compared; else the ones to come find these
            for i in list(self.fresh):
                self.compare(int(self.at[i]), len(self.ids))

    def sweep(self) -> bool:
        """Each place in turn, until no reversal from there gains; whether any did."""
        x, inner, better = 0, False, False
        while x < len(self.k):
            gain, y, cut = self.best(x, inner)
            if gain > LEAST:
                better = True
                if inner:  # the first item of the run stays
                    self.k, self.c = np.insert(self.k, x, self.k[x]), np.insert(self.c, x, 1)
                    self.c[x + 1] -= 1
                    self.e, self.ids = np.insert(self.e, x, self.own[self.k[x]]), np.insert(self.ids, x, self.edge())
                    x, y, inner = x + 1, y + 1, False
                self.reverse(x, y, cut)
            elif not inner and self.c[x] >= 2:
                inner = True  # of the places within a run one is as good as the next
            else:
                x, inner = x + 1, False
        self.swept = True
        new = np.append(True, self.k[1:] != self.k[:-1])
        if not new.all():
            for i in self.ids[~new[1:]]:
                self.gone(i)
            self.c = np.add.reduceat(self.c, np.flatnonzero(new))
            self.k, self.e, self.ids = self.k[new], self.e[new[1:]], self.ids[new[1:]]
            self.places()
        return better

    def total(self) -> float:
        t = np.repeat(self.k, self.c)
        v = self.own[t[:-1]]
        v[np.cumsum(self.c)[:-1] - 1] = self.e
        return float(v.sum())


def starts(n: int, restarts: int, seed: int = 408) -> list[int]:
    g = np.random.default_rng(seed)
    return [int(g.integers(n)) for _ in range(restarts)]


def greatest(w, kind: np.ndarray, start: int) -> float:
    """Greatest sum of values of neighbours that is found from an item."""
    own = np.array([w.one(k, k) for k in range(w.size)])
    chain = Chain(w, own, np.flatnonzero(np.bincount(kind, minlength=w.size) >= 2), *greedy(w, kind, start))
    while chain.sweep():
        pass
    return chain.total()
