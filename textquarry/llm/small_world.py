"""A hierarchical navigable small-world graph over one shard's unit vectors; searches run for many queries in lockstep."""

from __future__ import annotations

import io

import numpy as np

DEGREE = 16
BUILD_BEAM = 48
_BLOCK = 512


class Layer:
    def __init__(self, nodes: np.ndarray, degree: int):
        self.nodes = nodes  # graph-wide index of each node here
        self.out = np.full((len(nodes), degree), -1, np.int32)
        self.local = {int(g): i for i, g in enumerate(nodes)}


def _diverse(query: np.ndarray, ids: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """For each query up to `most` of its candidates (best first, -1 for none): those nearer to it than to any taken one, then the nearest left."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    v = vectors[np.maximum(ids, 0)]
    between = np.einsum("bkd,bld->bkl", v, v)
    taken = np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        near = np.where(taken, between[:, k, :], -np.inf).max(axis=1)
        taken[:, k] = (ids[:, k] >= 0) & (sims[:, k] > near) & (taken.sum(axis=1) < most)
    rank = np.argsort(np.where(ids < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, rank, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


class SmallWorld:
    """Built by inserting nodes in batches, each searched for in the graph so far and compared with the rest of its batch."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.vectors = vectors
        self.layers: list[Layer] = []  # top first
        for level in range(int(levels.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(levels >= level)
            nodes = nodes[np.argsort(-levels[nodes], kind="stable")]
            layer = Layer(nodes, 2 * DEGREE if level == 0 else DEGREE)
            self._fill(layer)
            self.layers.append(layer)

    def _fill(self, layer: Layer) -> None:
        n, at = len(layer.nodes), 0
        vectors = self.vectors[layer.nodes]
        while at < n:
            batch = np.arange(at, min(n, at + max(64, min(_BLOCK, at // 2))))
            q = vectors[batch]
            mates = q @ q.T
            np.fill_diagonal(mates, -np.inf)
            k = min(DEGREE, len(batch) - 1)
            near = np.argsort(-mates, axis=1)[:, :k]
            ids, sims = batch[near] if k else np.zeros((len(batch), 0), int), np.take_along_axis(mates, near, 1)
            if at:
                found, score = self._beam(q, self._entries(q, layer), layer, BUILD_BEAM, vectors)
                ids, sims = np.hstack([ids, found]), np.hstack([sims, score])
            chosen = _diverse(q, ids, sims, vectors, DEGREE)
            layer.out[batch, :DEGREE] = chosen
            self._reverse(layer, batch, chosen, vectors)
            at = int(batch[-1]) + 1

    def _reverse(self, layer: Layer, batch: np.ndarray, chosen: np.ndarray, vectors: np.ndarray) -> None:
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("ed,ed->e", vectors[source], vectors[target])
        order = np.lexsort((-sims, target))
        source, target, sims = source[order], target[order], sims[order]
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, int)
        rank = np.arange(len(target)) - np.repeat(heads, np.diff(np.append(heads, len(target))))
        most = layer.out.shape[1]
        keep = rank < most
        source, target, rank = source[keep], target[keep], rank[keep]
        unique, row = np.unique(target, return_inverse=True)
        for first in range(0, len(unique), _BLOCK):
            mine = unique[first : first + _BLOCK]
            here = (row >= first) & (row < first + len(mine))
            more = np.full((len(mine), most), -1)
            more[row[here] - first, rank[here]] = source[here]
            old = layer.out[mine]
            more[(more[:, :, None] == old[:, None, :]).any(axis=2)] = -1
            ids = np.hstack([old, more])
            ids = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), 1)
            ids = ids[:, : max(most, int((ids >= 0).sum(axis=1).max(initial=0)))]
            full = (ids >= 0).sum(axis=1) > most
            layer.out[mine[~full]] = ids[~full, :most]
            if full.any():
                ids = ids[full]
                s = np.where(ids >= 0, np.einsum("bd,bkd->bk", vectors[mine[full]], vectors[np.maximum(ids, 0)]), -np.inf)
                layer.out[mine[full]] = _diverse(vectors[mine[full]], ids, s, vectors, most)

    def _entries(self, q: np.ndarray, below: Layer) -> np.ndarray:
        """Where to begin in `below`: what a greedy descent through the finished layers ends at."""
        entry = np.zeros((len(q), 1), np.int64)
        for i, layer in enumerate(self.layers):
            found, _ = self._beam(q, entry, layer, 1, self.vectors[layer.nodes])
            target = self.layers[i + 1] if i + 1 < len(self.layers) else below
            entry = np.array([[target.local[int(layer.nodes[x])]] for x in found[:, 0]])
            if target is below:
                break
        return entry

    def _beam(self, q: np.ndarray, entry: np.ndarray, layer: Layer, width: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes (layer's own numbering, -1 for none) that a beam search from the entries finds, best first."""
        b, n = len(q), len(layer.nodes)
        seen = np.full((b, n), -1, np.int16)
        rows = np.arange(b)[:, None]
        ids = np.full((b, width), -1)
        sims = np.full((b, width), -np.inf, np.float32)
        done = np.ones((b, width), bool)

        def offer(who: np.ndarray, new: np.ndarray) -> None:
            k = np.arange(new.shape[1], dtype=np.int16)[None, :]
            at = np.maximum(new, 0)
            fresh = (new >= 0) & (seen[who[:, None], at] < 0)
            seen[np.broadcast_to(who[:, None], new.shape)[fresh], new[fresh]] = np.broadcast_to(k, new.shape)[fresh]
            fresh &= seen[who[:, None], at] == k
            s = np.where(fresh, np.einsum("bd,bkd->bk", q[who], vectors[at]), -np.inf)
            all_ids, all_sims = np.hstack([ids[who], np.where(fresh, new, -1)]), np.hstack([sims[who], s])
            all_done = np.hstack([done[who], ~fresh])
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[who], sims[who], done[who] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1), np.take_along_axis(all_done, order, 1)

        offer(np.arange(b), entry)
        at_once = min(4, width)
        active = np.arange(b)
        while len(active):
            waiting = ~done[active]
            active = active[waiting.any(axis=1)]
            if not len(active):
                break
            first = np.argsort(done[active], axis=1, kind="stable")[:, :at_once]
            open_ = ~np.take_along_axis(done[active], first, 1)
            chosen = np.where(open_, np.take_along_axis(ids[active], first, 1), -1)
            done[active[:, None], first] = True
            out = np.where((chosen >= 0)[:, :, None], layer.out[np.maximum(chosen, 0)], -1)
            offer(active, out.reshape(len(active), -1))
        del rows
        return ids, sims

    def search(self, q: np.ndarray, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Graph-wide indices and similarities of the best `width`; `own`: each query's index if it is a node itself."""
        last = self.layers[-1]
        entry = self._entries(q, last) if len(self.layers) > 1 else np.zeros((len(q), 1), np.int64)
        if len(self.layers) > 1:
            entry = entry.reshape(len(q), 1)
        if own is not None:
            entry = np.hstack([entry, np.array([[last.local[int(x)]] for x in own])])
        found, sims = self._beam(q, entry, last, width, self.vectors[last.nodes])
        return np.where(found >= 0, last.nodes[np.maximum(found, 0)], -1), sims

    def dumped(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, v=self.vectors, **{f"n{i}": x.nodes for i, x in enumerate(self.layers)}, **{f"o{i}": x.out for i, x in enumerate(self.layers)})
        return to.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> SmallWorld:
        z = np.load(io.BytesIO(data))
        g = cls.__new__(cls)
        g.vectors, g.layers = z["v"], []
        for i in range(sum(k.startswith("n") for k in z.files)):
            layer = Layer(z[f"n{i}"], 1)
            layer.out = z[f"o{i}"]
            g.layers.append(layer)
        return g


def levels_of(hashes: np.ndarray) -> np.ndarray:
    """Geometric levels from uniform 64-bit hashes: one node in DEGREE reaches each next level."""
    u = (hashes >> np.uint64(11)).astype(np.float64) / 2**53
    return np.minimum(np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(DEGREE)), 8).astype(int)
