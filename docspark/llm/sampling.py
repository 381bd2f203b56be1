"""SentencePiece encoding by Gumbel top-k sampling of segmentations without replacement, and decoding.

The lattice of a text has a node between any two characters and an edge for each piece of
the vocabulary, or the bytes of a character that no piece holds. With the chances of all
ways to the end known at each node, a segmentation is a walk in which each step's chance
given the steps before is known. The search is best-first over sets of walks: a set's
bound is the largest perturbed log-chance of its members, a Gumbel variable placed at the
log-chance of the set and cut off at the bound of the set it is taken from. Opening the
best set yields the walk that reaches the bound, and sets of the walks that leave it: one
for each of its first steps, and one for all later steps together, which is split up if
it ever becomes the best. The first k walks opened are the k largest of all perturbed
walks, so they are k distinct samples without replacement, and the bound that is best
after them gives the chance of each to be among them.

Two neighbours that stand together in no piece cut the lattice, so it falls into short
stretches, which recur; each worker keeps solved ones in tables of fixed room.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import table, text_of

U64 = np.uint64
#: Edges of solved stretches that a worker keeps (28 bytes each), and code points of text worked on at once.
KEPT, BATCH = 3_000_000, 1 << 18
#: Code points of new stretches solved at once, and the longest stretch whose weights need no powers of two.
GROUP, SHORT = 1 << 16, 12
#: Steps of a walk have a set of their own while the chance to get there is at least e to the power of -NEAR (0 or more).
NEAR = 60.0
SPACE = "▁"


def load(path: str, sharpness: float = 1.0, rank_shift: float = 10.0) -> dict:
    """Pieces of a SentencePiece model with weights, as a trie in a double array.

    A BPE model knows the order of its pieces but no chances; a piece of rank r (its
    negated score) weighs (rank_shift + r) ** -sharpness, as if frequencies followed
    Zipf's law. Pieces without a rank and single bytes weigh as much as the last.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    weights: dict[str, tuple[int, float]] = {}
    pieces: list[bytes] = []
    bytes_at = {}
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_at[int(piece[3:-1], 16)] = i
            pieces.append(bytes([int(piece[3:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(piece.replace(SPACE, " ").encode())
            rank = -sp.get_score(i)
            weights[piece] = (i, (rank_shift + (rank if 0 <= rank <= n else n)) ** -sharpness)
    # Classes of characters: 0 is in no piece, then those in pieces of several, then all others.
    several = sorted({c for p in weights if len(p) > 1 for c in p})
    alone = sorted({c for p in weights for c in p} - set(several))
    classes = np.zeros(0x110000, np.uint16)
    classes[[ord(c) for c in several + alone]] = np.arange(1, len(several) + len(alone) + 1)
    together = np.zeros((len(several) + 1, len(several) + 1), bool)
    for p in weights:
        if len(p) > 1:
            together[classes[[ord(c) for c in p[:-1]]], classes[[ord(c) for c in p[1:]]]] = True
    children: dict[str, dict[int, str]] = {"": {}}
    for p in weights:
        for size in range(len(p)):
            children.setdefault(p[: size + 1], {})
            children[p[:size]][int(classes[ord(p[size])])] = p[: size + 1]
    base, owner, slot = _double_array(children, len(several) + len(alone) + 1)
    piece_at, weight_at = np.full(len(owner), -1, np.int32), np.zeros(len(owner))
    for p, (i, w) in weights.items():
        piece_at[slot[p]], weight_at[slot[p]] = i, w
    sizes = np.array([len(p) for p in pieces], np.int64)
    return {
        "weights": weights,
        "classes": classes,
        "together": together,
        "base": base,
        "owner": owner,
        "piece_at": piece_at,
        "weight_at": weight_at,
        "pieces": pieces,
        "piece_bytes": np.frombuffer(b"".join(pieces), np.uint8),
        "piece_from": np.cumsum(sizes) - sizes,
        "piece_size": sizes,
        "bytes": np.array([bytes_at[b] for b in range(256)], np.int32),
        "byte_weight": (rank_shift + n) ** -sharpness,
        "longest": max(map(len, weights)),
    }


def _double_array(children: dict[str, dict[int, str]], n_classes: int) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """A trie as (base, owner, slot of each beginning): the child of the state in slot s by class c is in slot
    base[s] + c if owner[base[s] + c] is s. The root is in slot 0. Wide states are placed first, each where it first fits."""
    room = len(children) + 2 * n_classes
    free = np.ones(room, bool)
    free[0] = False
    slot, bases = {"": 0}, {}
    lowest = 1
    for name in sorted((x for x in children if children[x]), key=lambda x: -len(children[x])):
        own = sorted(children[name])
        while True:
            while lowest < room and not free[lowest]:
                lowest += 1
            if len(own) == 1:
                at = max(lowest - own[0], 0)
                while at + own[0] < room and not free[at + own[0]]:
                    at += 1
                fits = np.array([at])
            else:
                start = max(lowest - own[0], 0)
                span = room - own[-1] - start
                fits = np.flatnonzero(np.logical_and.reduce([free[start + c : start + c + span] for c in own])) + start if span > 0 else []
            if len(fits) and fits[0] + own[-1] < room:
                break
            free = np.concatenate([free, np.ones(n_classes, bool)])
            room += n_classes
        bases[name] = int(fits[0])
        for c in own:
            free[bases[name] + c] = False
            slot[children[name][c]] = bases[name] + c
    base, owner = np.zeros(room + n_classes, np.int32), np.full(room + n_classes, -1, np.int32)
    for name, at in bases.items():
        base[slot[name]] = at
        for c in children[name]:
            owner[at + c] = slot[name]
    return base, owner, slot


class Lattice:
    """Solved stretches as flat tables: a node's edges, the longest first, with their sums of
    chances, log-chances, targets and pieces; and where each stretch's first node is, by its hash."""

    def __init__(self, model: dict):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.n_nodes = self.n_edges = self.n_known = 0
        if not hasattr(self, "first") or len(self.cum) > KEPT:
            # Room for all that is kept from the start: memory is taken only as it is filled.
            nodes = KEPT // 2
            self.first, self.points = np.zeros(nodes + 1, np.int32), np.zeros(nodes + 1, np.uint32)
            self.cum, self.log = np.zeros(KEPT), np.zeros(KEPT)
            self.to, self.piece = np.zeros(KEPT, np.int32), np.zeros(KEPT, np.int32)
        self.keys, self.nodes = np.zeros(1 << 16, U64), np.zeros(1 << 16, np.int32)
        self.points[0] = _START

    def _room(self, nodes: int, edges: int) -> None:
        """Tables grow by half if one batch brings more than there is room for."""
        if nodes + 1 > len(self.first):
            for name in ("first", "points"):
                setattr(self, name, _grown(getattr(self, name), nodes + 1))
        if edges > len(self.cum):
            for name in ("cum", "log", "to", "piece"):
                setattr(self, name, _grown(getattr(self, name), edges))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The first node of each stretch, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        mask = U64(len(self.keys) - 1)
        who, h = np.arange(len(hashes)), hashes
        at = h & mask
        while len(who):
            key = self.keys[at]
            hit = key == h
            out[who[hit]] = self.nodes[at[hit]]
            on = np.flatnonzero(~hit & (key != 0))
            who, h, at = who[on], h[on], (at[on] + U64(1)) & mask
        return out

    def _put(self, hashes: np.ndarray, nodes: np.ndarray) -> None:
        """Adds distinct new stretches; the table is kept at most half full."""
        self.n_known += len(hashes)
        if self.n_known * 2 > len(self.keys):
            old = np.flatnonzero(self.keys)
            hashes, nodes = np.concatenate([self.keys[old], hashes]), np.concatenate([self.nodes[old], nodes])
            size = 1 << (self.n_known * 2).bit_length()
            self.keys, self.nodes = np.zeros(size, U64), np.zeros(size, np.int32)
        mask = U64(len(self.keys) - 1)
        at = hashes & mask
        while len(hashes):
            bare = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[bare]] = hashes[bare]
            # Where two met in one slot, the last one has it.
            mine = self.keys[at] == hashes
            self.nodes[at[mine]] = nodes[mine]
            on = ~mine
            hashes, nodes, at = hashes[on], nodes[on], (at[on] + U64(1)) & mask

    def _solve(self, points: np.ndarray, lens: np.ndarray) -> None:
        """Appends the nodes and edges of some stretches, whose code points are given one after another."""
        m = self.model
        n, base = len(points), self.n_nodes
        ends = np.cumsum(lens)
        left = np.repeat(ends, lens) - np.arange(n)
        # A place of class 0 behind each stretch ends every piece.
        place = np.arange(n) + np.repeat(np.arange(len(lens)), lens)
        kinds = np.zeros(n + len(lens) + 1, np.int64)
        kinds[place] = m["classes"][points]
        counts, found = np.zeros(n, np.int32), []
        at, state = np.arange(n), np.zeros(n, np.int64)
        for size in range(1, m["longest"] + 1):
            nxt = m["base"][state] + kinds[place[at] + size - 1]
            go = np.flatnonzero(m["owner"][nxt] == state)
            at, state = at[go], nxt[go]
            piece = m["piece_at"][state]
            if size == 1:
                # A character without a piece of its own is spelled in bytes.
                ids, w = -1 - points.astype(np.int32), np.full(n, m["byte_weight"])
                w **= 1 + (points > 0x7F).astype(int) + (points > 0x7FF) + (points > 0xFFFF)
                is_piece = piece >= 0
                own = at[is_piece]
                ids[own], w[own] = piece[is_piece], m["weight_at"][state[is_piece]]
                whole = np.arange(n)
            else:
                is_piece = np.flatnonzero(piece >= 0)
                whole, ids, w = at[is_piece], piece[is_piece], m["weight_at"][state[is_piece]]
            if len(whole):
                found.append((whole, counts[whole], size, ids, w))
                counts[whole] += 1
            if not len(at):
                break
        after = np.cumsum(counts, dtype=np.int64)
        first = after - counts
        total = int(after[-1])
        ids, weight, size_of = np.empty(total, np.int32), np.empty(total), np.empty(total, np.int8)
        for whole, rank, size, own, w in found:
            # The longest edge comes first: it is mostly the likeliest.
            e = after[whole] - 1 - rank
            ids[e], weight[e], size_of[e] = own, w * 2.0 ** (8.0 * size), size
        node = np.repeat(np.arange(n), counts)
        to = node + size_of
        chance = self._chances(weight, to, counts, first, left, int(lens.max()) > SHORT)
        cum = chance.copy()
        for r in range(1, int(counts.max())):
            e = first[counts > r] + r
            cum[e] += cum[e - 1]
        cum[after - 1] = 1.0
        a, b = self.n_edges, self.n_edges + total
        self._room(base + n, b)
        self.first[base : base + n] = a + first
        self.first[base + n] = b
        self.points[base : base + n] = points
        self.points[base + ends - lens] |= _START
        self.points[base + n] = _START
        self.cum[a:b], self.log[a:b], self.piece[a:b] = cum, np.log(chance), ids
        self.to[a:b] = np.where(size_of >= left[node], -1, to + base)
        self.n_nodes, self.n_edges = base + n, b

    @staticmethod
    def _chances(weight: np.ndarray, to: np.ndarray, counts: np.ndarray, first: np.ndarray, left: np.ndarray, long: bool) -> np.ndarray:
        """The chance of each edge: its weight times that of all ways from its target to the end, by node.

        Weights are worked out shortest rest first. A factor of 256 per point cancels in the
        chances and keeps the numbers in range; in long stretches each node adds a power of two.
        """
        n = len(left)
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        per = counts[order]
        begin = np.cumsum(per, dtype=np.int64) - per
        edge = np.arange(len(weight)) - np.repeat(begin, per) + np.repeat(first[order], per)
        weight, to = weight[edge], to[edge]
        ahead, shift = np.ones(n + 1), np.zeros(n + 1, np.int64)
        out = np.empty(len(weight))
        levels = np.flatnonzero(np.diff(left[order], prepend=0))
        for lo, hi in zip(levels.tolist(), [*levels[1:].tolist(), n]):
            e0, e1 = int(begin[lo]), int(begin[hi - 1] + per[hi - 1])
            at, heads, t, each = order[lo:hi], begin[lo:hi] - e0, to[e0:e1], per[lo:hi]
            # The node behind the end counts 1; it is that of the next stretch, so it is set here.
            ends = t == np.repeat(at + left[at[0]], each)
            x = np.where(ends, 1.0, ahead[t])
            if long:
                lift = np.where(ends, 0, shift[t])
                ref = lift[heads + each - 1]
                x = np.ldexp(x, lift - np.repeat(ref, each))
            x *= weight[e0:e1]
            total = np.add.reduceat(x, heads)
            out[e0:e1] = x / np.repeat(total, each)
            if long:
                part, power = np.frexp(total)
                ahead[at], shift[at] = part, ref + power
            else:
                ahead[at] = total
        chance = np.empty(len(weight))
        chance[edge] = out
        return chance

    def nodes_of(self, points: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The first node of each stretch, solving the new ones."""
        hashes = _hashes(points, starts, lens)
        nodes = self._find(hashes)
        missing = np.flatnonzero(nodes < 0)
        if len(missing) and self.n_edges > KEPT * 4 // 5:
            self.clear()
            missing = np.arange(len(hashes))
        if len(missing):
            new, which, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            nodes[missing] = self._add(points, starts[missing[which]], lens[missing[which]])[back]
            self._put(new, nodes[missing[which]])
        # Equal hashes are no proof: the points themselves have to agree, and the stretch to end where its nodes do.
        begin = np.cumsum(lens) - lens
        inside = np.arange(int(lens.sum())) - np.repeat(begin, lens)
        wanted = points[inside + np.repeat(starts, lens)]
        wanted[begin] |= _START
        same = self.points[np.minimum(inside + np.repeat(nodes, lens), self.n_nodes)] == wanted
        wrong = np.flatnonzero(~np.logical_and.reduceat(same, begin) | (self.points[np.minimum(nodes + lens, self.n_nodes)] < _START))
        if len(wrong):
            nodes[wrong] = self._add(points, starts[wrong], lens[wrong])
        return nodes

    def _add(self, points: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Solves stretches in groups, short ones first."""
        order = np.argsort(lens, kind="stable")
        total = np.cumsum(lens[order])
        nodes, lo = np.empty(len(lens), np.int64), 0
        n_short = int(np.searchsorted(lens[order], SHORT, "right"))
        while lo < len(order):
            done = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, done + GROUP, "right")))
            hi = min(hi, n_short) if lo < n_short else hi
            own = order[lo:hi]
            n = lens[own]
            begin = np.cumsum(n) - n
            nodes[own] = self.n_nodes + begin
            self._solve(points[np.arange(int(n.sum())) + np.repeat(starts[own] - begin, n)], n)
            lo = hi
        return nodes

    def walk(self, nodes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walks from each node to the end of its stretch. Edges one walk after another, and how many each has.

        key: a random 64-bit number for each walk, from which its steps are drawn.
        """
        steps = []
        at, who, k = nodes, np.arange(len(nodes)), key
        while len(at):
            k = tc.mix64(k + U64(0x9E3779B97F4A7C15))
            u = (k >> U64(11)).astype(np.float64) * 2.0**-53
            e = self.first[at].astype(np.int64)
            far = np.flatnonzero(u >= self.cum[e])
            while len(far):
                e[far] += 1
                far = far[u[far] >= self.cum[e[far]]]
            steps.append((who, e))
            at = self.to[e]
            go = np.flatnonzero(at >= 0)
            at, who, k = at[go], who[go], k[go]
        count = np.zeros(len(nodes), np.int64)
        for who, _ in steps:
            count[who] += 1
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for depth, (who, e) in enumerate(steps):
            out[begin[who] + depth] = e
        return out, count


#: Marks the first point of a stretch.
_START = np.uint32(1 << 31)


def _grown(old: np.ndarray, least: int) -> np.ndarray:
    new = np.zeros(max(least, len(old) * 3 // 2), old.dtype)
    new[: len(old)] = old
    return new


def _hashes(points: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A hash of each stretch that is never 0."""
    up, down = tc._powers(len(points))
    sums = np.zeros(len(points) + 1, U64)
    np.cumsum(tc.mix64(points.astype(U64) + U64(1)) * up[: len(points)], out=sums[1:])
    return tc.mix64((sums[starts + lens] - sums[starts]) * down[starts] + lens.astype(U64)) | U64(1)


def cut_up(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts without empty ones as code points, with a leading space and spaces as U+2581; starts and lengths of
    the stretches, cut where no piece crosses; and how many stretches each text has."""
    points = np.frombuffer((SPACE + SPACE.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[points == 32] = ord(SPACE)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(sizes) - sizes
    kinds = model["classes"][points].astype(np.int64)
    n = len(model["together"])
    kinds[kinds >= n] = 0
    new = np.empty(len(points), bool)
    new[1:] = ~model["together"].ravel()[kinds[:-1] * n + kinds[1:]]
    new[first] = True
    starts = np.flatnonzero(new)
    return points, starts, np.diff(starts, append=len(points)), np.diff(np.searchsorted(starts, np.append(first, len(points))))


def _gumbel(u: float) -> float:
    return -math.log(-math.log(u))


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((tc.mix64(key) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _cut_off(mass: float, bound: float, u: float) -> float:
    """A Gumbel variable at ``mass``, given that it lies below ``bound``."""
    return mass - math.log(math.exp(min(mass - bound, 700.0)) - math.log(u or 1e-300))


class _Search:
    """The state of one text: walks found, and the sets of walks still closed as a heap.

    A set is (-bound, number, parent, step, edges left out, log-chance to get there): the
    walks that take the parent's steps before ``step`` and there none of the edges left out.
    Without such edges it is a set of all walks that leave the parent at ``step`` or later.
    """

    def __init__(self, seed: int, stretches_from: int, stretches_to: int):
        self.seed, self.lo, self.hi = seed, stretches_from, stretches_to
        self.heap: list[tuple] = []
        self.found: list[tuple[float, float, np.ndarray]] = []
        self.number = 0

    def push(self, value: float, parent: int, step: int, left_out: tuple, before: float) -> None:
        self.number += 1
        heapq.heappush(self.heap, (-value, self.number, parent, step, left_out, before))


def sample_batch(lattice: Lattice, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k (edges, log-chance, perturbed log-chance, inclusion), best first."""
    sizes = np.zeros(len(texts), np.int64)
    full = [i for i, t in enumerate(texts) if t]
    nodes = np.empty(0, np.int64)
    if full:
        points, starts, lens, sizes[full] = cut_up(lattice.model, [texts[i] for i in full])
        nodes = lattice.nodes_of(points, starts, lens)
    ends = np.cumsum(sizes)
    searches = [_Search(int(s), int(e - n), int(e)) for s, e, n in zip(seeds, ends, sizes)]
    for r in range(k):
        # Open the best set of each text: where its walk starts anew.
        jobs = []
        for s in searches:
            if s.lo == s.hi:
                continue
            if r == 0:
                g = _gumbel(float(_uniform(np.array([s.seed], U64))[0]))
                jobs.append((s, g, np.empty(0, np.int64), 0.0, s.lo))
            elif s.heap:
                jobs.append(_open(lattice, s, r))
        if not jobs:
            break
        # All walks to the ends of all texts at once.
        lens = np.array([s.hi - at for s, _, _, _, at in jobs], np.int64)
        doc = np.repeat(np.arange(len(jobs)), lens)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat([j[4] for j in jobs], lens)
        seed = np.array([(s.seed * 31 + 7919 * (r + 1)) & tc.MASK for s, *_ in jobs], U64)
        within = place - np.repeat([s.lo for s, *_ in jobs], lens)
        key = tc.mix64(seed[doc] + within.astype(U64) * U64(0xD1342543DE82EF95))
        edges, count = lattice.walk(nodes[place], key)
        del place, within, key, doc
        steps = np.concatenate([[0], np.cumsum(count)])
        begin = steps[np.concatenate([[0], np.cumsum(lens)])]
        fall = np.zeros(len(edges) + 1)
        np.cumsum(-lattice.log[edges], out=fall[1:])
        first, last = begin[:-1], begin[1:]
        # Steps that get a set of their own, per walk; those behind share one.
        many = np.array([np.searchsorted(fall[a:b], fall[a] + NEAR, "right") for a, b in zip(first.tolist(), last.tolist())], np.int64)
        own = np.repeat(np.arange(len(jobs)), many)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        near = nth + first[own]
        rest = fall[first[own]] - fall[near] + np.array([j[3] for j in jobs])[own]
        bound = np.array([j[1] for j in jobs])[own]
        with np.errstate(divide="ignore", over="ignore"):
            mass = rest + np.log(-np.expm1(np.minimum(lattice.log[edges[near]], 0)))
            u = _uniform(seed[own] ^ (U64(0xA0761D6478BD642F) + nth.astype(U64)))
            value = mass - np.log(np.exp(mass - bound) - np.log(u))
        value[~np.isfinite(mass)] = -np.inf
        c = 0
        for (s, g, prefix, prefix_log, _), a, b, m in zip(jobs, first.tolist(), last.tolist(), many.tolist()):
            path = np.concatenate([prefix, edges[a:b]])
            s.found.append((prefix_log - float(fall[b] - fall[a]), g, path))
            # Of the sets that leave this walk only as many as there are walks left to find can matter.
            v = value[c : c + m]
            best = np.argpartition(v, m - (k - r))[m - (k - r) :] if m > k - r else np.arange(m)
            for t in best.tolist():
                if v[t] > -np.inf:
                    s.push(float(v[t]), len(s.found) - 1, len(prefix) + t, (int(edges[a + t]),), float(rest[c + t]))
            c += m
            if m < b - a:
                _push_later(lattice, s, len(s.found) - 1, len(prefix) + m, prefix_log - float(fall[a + m] - fall[a]), g, random.Random(s.seed * 1_000_003 - 1 - r).random())
    out = []
    for s in searches:
        if s.lo == s.hi:
            out.append([(np.empty(0, np.int64), 0.0, 0.0, 1.0)])
            continue
        limit = -s.heap[0][0] if s.heap else -np.inf
        mine = []
        for log, g, path in s.found:
            q = 1.0 if limit == -np.inf else -math.expm1(-math.exp(min(log - limit, 700.0)))
            mine.append((path, log, g, q))
        out.append(mine)
    return out


def _push_later(lattice: Lattice, s: _Search, parent: int, step: int, before: float, bound: float, u: float) -> None:
    """The set of all walks that leave a found one at ``step`` or later."""
    others = -math.expm1(min(float(lattice.log[s.found[parent][2][step:]].sum()), 0.0))
    if others > 0:
        s.push(_cut_off(before + math.log(others), bound, u), parent, step, (), before)


def _split(lattice: Lattice, s: _Search, bound: float, parent: int, step: int, before: float, draw) -> None:
    """Sets by step in place of the best set, of walks that leave ``parent`` at ``step`` or later.

    The largest walk lies in one of them, each with the chance of its share.
    """
    log = np.minimum(lattice.log[s.found[parent][2][step:]], 0.0)
    ahead = before + np.cumsum(log) - log
    many = int(np.searchsorted(-ahead, NEAR - before, "right"))
    with np.errstate(divide="ignore"):
        mass = (ahead[:many] + np.log(-np.expm1(log[:many]))).tolist()
    if many < len(log):
        others = -math.expm1(float(log[many:].sum()))
        mass.append(float(ahead[many]) + math.log(others) if others > 0 else -math.inf)
    share = np.cumsum(np.exp(np.array(mass) - max(mass)))
    best = min(int(np.searchsorted(share, draw() * share[-1], "right")), len(mass) - 1)
    for i, x in enumerate(mass):
        if x > -math.inf:
            value = bound if i == best else _cut_off(x, bound, draw())
            left_out = (int(s.found[parent][2][step + i]),) if i < many else ()
            s.push(value, parent, step + i, left_out, float(ahead[i]))


def _open(lattice: Lattice, s: _Search, r: int) -> tuple:
    """Takes the best set: another edge than those left out at its step, then on to the end of the stretch."""
    draw = random.Random(s.seed * 1_000_003 + r).random
    while True:
        value, _, parent, step, left_out, before = heapq.heappop(s.heap)
        bound = -value
        if left_out:
            break
        _split(lattice, s, bound, parent, step, before, draw)
    path = s.found[parent][2]
    where = s.lo + int(np.count_nonzero(lattice.to[path[:step]] < 0))
    one = left_out[0]
    node = int(np.searchsorted(lattice.first[: lattice.n_nodes + 1], np.int32(one), "right")) - 1
    options = [e for e in range(int(lattice.first[node]), int(lattice.first[node + 1])) if e not in left_out]
    chances = [math.exp(lattice.log[e]) for e in options]
    u, pick = draw() * sum(chances), options[-1]
    for e, c in zip(options, chances):
        u -= c
        if u < 0:
            pick = e
            break
    rest = [e for e in options if e != pick]
    if rest:
        # What is left at this step stays a set of its own, below the bound of this one.
        mass = before + math.log(max(sum(c for e, c in zip(options, chances) if e != pick), 1e-300))
        s.push(_cut_off(mass, bound, draw()), parent, step, (*left_out, pick), before)
    prefix, log = [*path[:step].tolist(), pick], before + float(lattice.log[pick])
    at = int(lattice.to[pick])
    while at >= 0:
        a, b = int(lattice.first[at]), int(lattice.first[at + 1])
        e = a + min(int(np.searchsorted(lattice.cum[a:b], draw(), "right")), b - a - 1)
        others = -math.expm1(min(float(lattice.log[e]), 0.0))
        if others > 0:
            # The walk this belongs to is the next one found.
            s.push(_cut_off(log + math.log(others), bound, draw()), len(s.found), len(prefix), (e,), log)
        prefix.append(e)
        log += float(lattice.log[e])
        at = int(lattice.to[e])
    return s, bound, np.array(prefix, np.int64), log, where + 1


def _spelled(model: dict, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces with characters that have none (-1 - code point) spelled in bytes, and how many each sample has."""
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, lens
    points = -1 - ids[bare].astype(np.int64)
    n = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    each = np.ones(len(ids), np.int64)
    each[bare] = n
    at = np.concatenate([[0], np.cumsum(each)])
    out = np.repeat(ids, each)
    for i in range(4):
        has = n > i
        low = points[has] >> (6 * (n[has] - 1 - i)) & 0x3F
        lead = np.where(n[has] == 1, points[has], np.array([0, 0, 0xC0, 0xE0, 0xF0])[n[has]] | points[has] >> (6 * (n[has] - 1)))
        out[at[bare[has]] + i] = model["bytes"][lead if i == 0 else 0x80 | low]
    ends = at[np.cumsum(lens)]
    return out, np.diff(ends, prepend=0)


def _spell_texts(model: dict, ids: np.ndarray, lens: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether the pieces of each sample, joined, are its text."""
    size = model["piece_size"][ids]
    after = np.concatenate([[0], np.cumsum(size)])
    flat = model["piece_bytes"][np.repeat(model["piece_from"][ids] - after[:-1], size) + np.arange(after[-1])].tobytes()
    ends = after[np.cumsum(lens)].tolist()
    return np.array([flat[a:b] == t for a, b, t in zip([0, *ends], ends, texts)], bool)


RESULT = "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, inclusion double, ids array<int>, decoded boolean"


def encode(docs: DataFrame, path: str, k: int = 2, seed: int = 1, sharpness: float = 1.0) -> DataFrame:
    """Up to k rows per input row: doc_id, rank (1 is the best), n_pieces, log_prob (of the segmentation, given the
    text), perturbed, inclusion (chance to be among the k, given the bound of the next), ids, decoded.

    Samples are distinct and depend on doc_id, text and ``seed`` only, so rows that repeat get
    equal samples. A text with fewer than k segmentations gets all it has. Null and empty
    texts get one row without pieces. ``decoded`` says that the pieces spell the text; it
    is false only for texts with U+2581, which pieces cannot tell from a space. A null
    doc_id stays null. An empty table gives an empty result; further columns are ignored.
    A step whose chance is below 2**-53 at its node may be lost to rounding.
    """
    model = docs.sparkSession.sparkContext.broadcast({name: x for name, x in load(path, sharpness).items() if name != "weights"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The tables live as long as the task: a worker holds nothing between stages.
        lattice = Lattice(model.value)
        for b in batches:
            sizes = pc.utf8_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in tc.slices(sizes, BATCH):
                yield _encoded(lattice, b.slice(i, j - i), k, seed)

    text, doc_id = text_of(docs), docs["doc_id"].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(doc_id, F.lit(-1)), text).alias("key"))
    return rows.mapInArrow(run, RESULT)


def _encoded(lattice: Lattice, part: pa.RecordBatch, k: int, seed: int) -> pa.RecordBatch:
    texts = part.column("text").to_pylist()
    seeds = tc.mix64(part.column("key").to_numpy().view(U64) + U64(seed))
    samples = sample_batch(lattice, texts, seeds, k)
    many = np.fromiter(map(len, samples), np.int64, len(samples))
    paths = [x for own in samples for x in own]
    lens = np.fromiter((len(x[0]) for x in paths), np.int64, len(paths))
    ids, lens = _spelled(lattice.model, lattice.piece[np.concatenate([x[0] for x in paths])], lens)
    wanted = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t, own in zip(texts, samples) for _ in own]
    row = np.repeat(np.arange(len(texts)), many)
    log, g, q = (np.array([x[c] for x in paths]) for c in (1, 2, 3))
    columns = {
        "doc_id": part.column("doc_id").take(pa.array(row)),
        "rank": pa.array(np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + 1, pa.int32()),
        "n_pieces": pa.array(lens, pa.int64()),
        "log_prob": pa.array(log.round(9)),
        "perturbed": pa.array(g.round(9)),
        "inclusion": pa.array(q.round(12)),
        "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(ids, pa.int32())),
        "decoded": pa.array(_spell_texts(lattice.model, ids, lens, wanted)),
    }
    return pa.record_batch(list(columns.values()), names=list(columns))


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``encoded`` with a further column ``text`` that its piece ids spell; null ids give null. The space
    before the first word goes. Bytes that are no UTF-8 become U+FFFD."""
    model = encoded.sparkSession.sparkContext.broadcast(load(path)["pieces"])

    @F.pandas_udf("string")
    def spell(ids):
        import pandas as pd

        pieces = model.value
        return pd.Series(
            [None if x is None else b"".join(pieces[i] for i in x).decode("utf-8", "replace").removeprefix(" ") for x in ids], dtype=object
        )

    return encoded.withColumn("text", spell(F.col(column)))


def op1_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
