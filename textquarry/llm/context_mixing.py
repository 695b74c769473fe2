"""The per-text part of the context-mixing model: binary decisions, hashed contexts, gated logistic mixing with online refinement.

A text is coded as its bytes (A-Z lower-cased) and one end symbol, each byte as the decisions on its path in the Huffman tree of what follows the
byte before it in the training texts. Each decision has a prediction from each of several contexts: a slot, hashed from the context and the tree
node, holds how often the decision went either way. The predictions' log odds are added up with weights that a gate (how sure the two longest
contexts are) selects, and that the text's own decisions so far refine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from textquarry.llm.words import LOWER, SPACE, mixed, prefix_sums, slices

END = 0xFF  # never a byte of UTF-8
#: Bytes of context, ascending; 0 bytes stands for the part of the word so far. One byte of context has a slot for each byte and node.
ORDERS = (1, 2, 3, 4, 6, 0)
_PAD = 8
#: Bytes before a window of a long text that its contexts see.
LEAD = 64
INPUTS = len(ORDERS) + 1
SURENESS = 8
GATES = SURENESS * SURENESS
#: Gates whose weights one text refines together.
GROUPS = 4
SOFT = 0.01
#: Units of log odds in which slots are held.
SCALE = 10
#: Decisions between two steps of the learning of weights.
BLOCK = 2048
#: Decisions between two refinements of a text's weights, and the step size for each decision.
REFINE, STEP = 64, 0.004
_EPS = 1e-5
#: The last input of every decision.
CONSTANT = 0.3
#: Counts of a slot are halved from here on; no slice of LEARN_BYTES adds more than 16 bits hold beyond it.
_MOST = 1 << 14
LEARN_BYTES, SCORE_BYTES = 24 << 10, 48 << 10
#: Bytes of texts that are refined side by side.
TOGETHER = 768 << 10
#: Decisions that are weighed, and texts that take their steps, at once: what they need fits a core's own cache.
_WEIGHED, _STEPPING = 4096, 256
#: Bytes of a decision's row of inputs: log odds of each order, the constant, and the group of its gate.
_ROW = 8
_ONES = np.ones(_ROW, np.float32)
#: Log odds of 1 - _EPS, which no decision goes beyond.
_SUREST = np.float32(np.log((1 - _EPS) / _EPS))
_LOG = (SCALE * np.log(np.arange(1 << 16) + SOFT)).astype(np.float32)


@dataclass
class Tree:
    """For each byte after each byte (code: 256 * before + byte) the nodes and turns on its path, one after another in flat arrays."""

    first: np.ndarray
    length: np.ndarray
    node: np.ndarray
    turn: np.ndarray


def _paths(counts: list[int]) -> list[list[tuple[int, int]]]:
    """(node, turn) from the root to each symbol; nodes are numbered from the root down."""
    heap: list[tuple[int, int, object]] = [(c, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    serial = len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], serial, (a[2], b[2])))
        serial += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in counts]
    level: list[tuple[object, list[tuple[int, int]]]] = [(heap[0][2], [])]
    number = 0
    while level:
        below = []
        for item, path in level:
            if isinstance(item, int):
                paths[item] = path
            else:
                below += [(item[0], [*path, (number, 0)]), (item[1], [*path, (number, 1)])]
                number += 1
        level = below
    return paths


def tree_of(counts: np.ndarray) -> Tree:
    """Huffman trees of 256 symbols (0xFF is the end) after each byte, from a matrix of counts. What was not seen after a byte ranks by its own count."""
    alone = counts.sum(axis=0)
    usual = np.ceil(alone * 100 / max(int(alone.sum()), 1)).astype(np.int64) + 1
    unseen = _paths(usual.tolist())
    length, flat = [], []
    for before in range(256):
        paths = _paths((counts[before] * 1000 + usual).tolist()) if counts[before].any() else unseen
        length += [len(p) for p in paths]
        flat += [x for p in paths for x in p]
    size = np.array(length)
    path = np.array(flat, np.int64).reshape(-1, 2)
    return Tree(np.cumsum(size) - size, size, path[:, 0].copy(), path[:, 1].astype(np.int8))


def windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int, bool]]:
    """(rows, bytes, offsets, lead, last): runs of whole texts of about `most` bytes (lead 0, last), or windows of one longer text, of which the first
    `lead` bytes are only context."""
    for rows, data, offsets in slices(batches, "text", most):
        if rows.num_rows > 1 or len(data) <= most:
            yield rows, data, offsets, 0, True
        else:
            for at in range(0, len(data), most):
                lead = min(at, LEAD)
                part = data[at - lead : at + most]
                yield rows, part, np.array([0, len(part)]), lead, at + most >= len(data)


@dataclass
class Decisions:
    slots: list[np.ndarray]  # for each order
    turn: np.ndarray
    begin: np.ndarray  # of each text, and the end of the last


def decisions(data: np.ndarray, offsets: np.ndarray, tree: Tree, bits: int, lead: int = 0, last: bool = True) -> Decisions:
    n = len(offsets) - 1
    size = np.diff(offsets)
    text = np.full(len(data) + n * (_PAD + 1), END, np.uint8)
    row = np.repeat(np.arange(n), size)
    text[np.arange(len(data)) + row * (_PAD + 1) + _PAD] = LOWER[data]
    starts = offsets[:-1] + np.arange(n) * (_PAD + 1) + _PAD  # of each text; its end symbol follows it
    coded = size + 1
    position = np.repeat(starts - (np.cumsum(coded) - coded), coded) + np.arange(len(data) + n)
    if lead or not last:
        position = position[lead : len(position) - (not last)]
        coded = np.array([len(position)])
    code = text.take(position - 1).astype(np.int64)
    code <<= 8
    code += text.take(position)
    length = tree.length.take(code)
    ends = np.cumsum(length)
    begin = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(coded)])]
    which = np.repeat(np.arange(len(code)), length)
    path = (tree.first.take(code) - (ends - length)).take(which)
    path += np.arange(len(which))
    node = tree.node.take(path)
    before, slots = text.astype(np.uint64), []
    before[1:] = before[:-1].copy()
    before[0], upto = 0, 1
    for k in ORDERS:
        if k > upto:
            grown = before.copy()
            grown[upto:] |= before[:-upto] << np.uint64(8 * upto)
            if k < 2 * upto:
                grown &= np.uint64((1 << 8 * k) - 1)
            before, upto = grown, k
        if k == 1:
            at = before.view(np.int64) << 8
        else:
            if k:
                h = before + np.uint64(k)
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
            else:
                total, inverses = prefix_sums(text)
                gap = SPACE.take(text)
                gap |= text == END
                word = np.zeros(len(text), np.int64)  # where the word to the left of each position begins
                word[1:] = np.maximum.accumulate(np.where(gap, np.arange(1, len(text) + 1), 0))[:-1]
                h = mixed((total[:-1] - total.take(word)) * inverses.take(word) + np.uint64(77))
            h >>= np.uint64(64 - bits)
            at = h.view(np.int64)
        at = at.take(position).take(which)
        at += node
        if k != 1:
            at &= (1 << bits) - 1
        slots.append(at)
    return Decisions(slots, tree.turn.take(path), begin)


def slot_bits(k: int, bits: int) -> int:
    return 16 if k == 1 else bits


def first_weights() -> np.ndarray:
    w = np.full((GATES, INPUTS), 0.3, np.float32)
    w[:, -1] = 0
    return w


def odds_of(counts: np.ndarray) -> np.ndarray:
    """Slots of (zeros, ones) as log odds in units of 1 / SCALE."""
    odds = SCALE * (np.log(counts[:, 1] + SOFT) - np.log(counts[:, 0] + SOFT))
    return np.clip(np.rint(odds), -127, 127).astype(np.int8)


def _count_odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of packed counts (zeros in the lower 16 bits, ones in the upper)."""
    pair = counts.view(np.uint16)
    v = _LOG.take(pair[1::2])
    v -= _LOG.take(pair[::2])
    np.rint(v, out=v)
    return np.clip(v, -127, 127, out=v).astype(np.int8)


_BYTES = np.arange(1 << 16, dtype=np.uint32)
#: Log odds of counts below 256, at zeros + 256 * ones.
_FEW = _count_odds((_BYTES & np.uint32(0xFF)) | (_BYTES >> np.uint32(8) << np.uint32(16)))


def _gate(odds: list[np.ndarray]) -> np.ndarray:
    """How far the two longest contexts' log odds are from even, each in steps of 16 units."""
    gate = np.abs(odds[-2])
    gate >>= 4
    gate *= np.int8(SURENESS)
    gate += np.abs(odds[-1]) >> 4
    return gate


def _in_rows(odds: list[np.ndarray], sign: np.ndarray | np.int8 = np.int8(1)) -> np.ndarray:
    """The inputs of each decision, times its sign, beside each other in units of 1 / SCALE."""
    rows = np.zeros((len(odds[0]), _ROW), np.int8)
    for k, v in enumerate(odds):
        rows[:, k] = v * sign
    rows[:, len(odds)] = np.int8(round(CONSTANT * SCALE)) * sign
    return rows


def _per_unit(weights: np.ndarray) -> np.ndarray:
    """Sets of weights for such rows."""
    out = np.zeros((len(weights), _ROW), np.float32)
    out[:, :INPUTS] = weights
    out *= np.float32(1 / SCALE)
    return out


def _mixed(x: np.ndarray, weights: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Sum of each row of inputs times the set `which` of weights; the same wherever the row lies."""
    w = weights.take(which, axis=0)
    w *= x
    z = w[:, 0] + w[:, 1]
    for k in range(2, INPUTS):
        z += w[:, k]
    return z


def _chance(z: np.ndarray) -> np.ndarray:
    out = np.negative(z)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


class Learner:
    """Counts and mixing weights of one share of the training texts, learnt in one pass: each slice is predicted from what came before it."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.counts = [np.zeros(1 << slot_bits(k, bits), np.uint32) for k in ORDERS]  # zeros in the lower 16 bits, ones in the upper
        self.weights, self.squares = first_weights(), np.full((GATES, INPUTS), 1e-10)

    def _odds(self, counts: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Log odds of each decision's slot; what has grown large is halved first."""
        if len(counts) <= len(slot):  # one for all decisions of a slot
            used = np.flatnonzero(counts)
            of_slot = np.zeros(len(counts), np.int8)
            of_slot[used] = self._odds(counts, used) if len(used) < len(counts) else _count_odds(counts)
            return of_slot.take(slot)
        seen = counts.take(slot)
        large = np.flatnonzero((seen & np.uint32(0xFF00FF00)) != 0)
        some = seen.take(large)
        many = np.unique(slot.take(large[(some & np.uint32(0xC000C000)) > 0]))
        if len(many):
            for _ in range(2):
                c = counts[many].view(np.uint16)
                counts[many] = ((c >> 1) + (c & 1)).view(np.uint32)
                many = many[(counts[many] & np.uint32(0xC000C000)) > 0]
            some = counts.take(slot.take(large))
        seen |= seen >> np.uint32(8)
        seen &= np.uint32(0xFFFF)
        odds = _FEW.take(seen)
        odds[large] = _count_odds(some)
        return odds

    def add(self, d: Decisions, rate: float = 0.05) -> None:
        odds, one = [], d.turn.astype(np.uint32) * np.uint32((1 << 16) - 1) + np.uint32(1)
        for counts, slot in zip(self.counts, d.slots, strict=True):
            odds.append(self._odds(counts, slot))
            np.add.at(counts, slot, one)
        # inside a block, decisions are ordered by gate, so that each gate's errors lie beside each other
        gate, n = _gate(odds), len(d.turn)
        key = np.repeat(np.arange(0, -(-n // BLOCK) * GATES, GATES, np.uint16 if n // BLOCK * GATES + GATES <= 1 << 16 else np.uint32), BLOCK)[:n]
        key += gate.view(np.uint8)
        order = np.argsort(key, kind="stable")
        rows = _in_rows(odds).view(np.int64).ravel().take(order).view(np.int8).reshape(-1, _ROW)
        gate, turn, key = gate.take(order).astype(np.int64), d.turn.take(order), key.take(order)
        firsts = np.flatnonzero(np.diff(key, prepend=key[:1] + 1))  # of each gate in each block
        bounds = np.searchsorted(firsts, np.arange(0, n + BLOCK, BLOCK))
        weights, step = _per_unit(self.weights), np.zeros((GATES, INPUTS))
        for i, at in enumerate(range(0, n, BLOCK)):
            x, g = rows[at : at + BLOCK].astype(np.float32), gate[at : at + BLOCK]
            z = (weights.take(g, axis=0) * x) @ _ONES
            np.minimum(z, np.float32(20), out=z)
            np.maximum(z, np.float32(-20), out=z)
            err = turn[at : at + BLOCK] - _chance(z)
            first = firsts[bounds[i] : bounds[i + 1]] - at
            step[:] = 0
            x *= np.repeat(err, _ROW).reshape(-1, _ROW)
            step[g.take(first)] = np.add.reduceat(x, first, axis=0)[:, :INPUTS] / (SCALE * BLOCK)
            self.squares += step * step
            self.weights += (rate * step / np.sqrt(self.squares)).astype(np.float32)
            weights = _per_unit(self.weights)
        self.n += n


@dataclass
class Evidence:
    """What the model says of each decision before refinement."""

    rows: np.ndarray  # its inputs, times -1 where the turn is 0, and the group of its gate, by the word's sureness
    z: np.ndarray  # the weighted sum of inputs
    turn: np.ndarray
    begin: np.ndarray


def evidence(d: Decisions, tables: list[np.ndarray], weights: np.ndarray) -> Evidence:
    odds = [table.take(slot) for slot, table in zip(d.slots, tables, strict=True)]
    gate, sign = _gate(odds), 2 * d.turn - np.int8(1)
    group, gate = (gate >> 1) & np.int8(GROUPS - 1), gate.astype(np.int64)
    rows, w, z = _in_rows(odds, sign), _per_unit(weights), np.empty(len(sign), np.float32)
    for at in range(0, len(z), _WEIGHED):
        z[at : at + _WEIGHED] = _mixed(rows[at : at + _WEIGHED].astype(np.float32), w, gate[at : at + _WEIGHED])
    z *= sign
    rows[:, INPUTS] = group
    return Evidence(rows, z, d.turn, d.begin)


def joined(parts: list[Evidence]) -> Evidence:
    if len(parts) == 1:
        return parts[0]
    before = np.cumsum([0, *(p.begin[-1] for p in parts)])
    begin = np.concatenate([p.begin[:-1] + at for p, at in zip(parts, before, strict=False)] + [before[-1:]])
    whole = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return Evidence(whole("rows"), whole("z"), whole("turn"), begin)


def log10_probabilities(e: Evidence, shift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each text's probability, and what each text has added to the weights of each group of gates.

    Each text starts from the learnt weights and adds to them (from `shift` on, if it is a later window), after every REFINE decisions, a step along
    its own errors. Many texts take a step at the same time, the longest first, so that those that have ended are always the last ones.
    """
    size = np.diff(e.begin)
    order = np.argsort(-size, kind="stable")
    steps = -(-size[order] // REFINE)
    first = np.cumsum(steps) - steps  # block of REFINE decisions that each text, the longest first, begins with
    to = np.empty(len(size), np.int64)
    to[order] = REFINE * first
    to = np.repeat(to - e.begin[:-1], size)
    to += np.arange(len(to))
    rows, z = np.zeros((int(steps.sum()), REFINE), np.int64), np.full((int(steps.sum()), REFINE), 30, np.float32)  # past a text's end all is sure
    rows.ravel()[to] = e.rows.view(np.int64).ravel()
    z.ravel()[to] = e.z * (2 * e.turn - np.int8(1))
    total = np.zeros(len(size))
    own = np.zeros((len(size), GROUPS, _ROW), np.float32)
    if shift is not None:
        own[:] = _per_unit(shift.reshape(-1, INPUTS)).reshape(own.shape)[order]
    step = np.float32(STEP / SCALE**2)
    for at in range(0, len(size), _STEPPING):
        w, much = own[at : at + _STEPPING], steps[at : at + _STEPPING]
        lanes = GROUPS * np.arange(len(w) * REFINE).reshape(-1, REFINE)
        for i, m in enumerate(np.searchsorted(-much, -np.arange(int(much[0]))).tolist()):  # m texts go on
            block = first[at : at + m] + i
            r = rows.take(block, axis=0).view(np.int8).reshape(m, REFINE, _ROW)
            x, group = r.astype(np.float32), (lanes[:m] + r[:, :, INPUTS]).ravel()
            v = (x @ w[:m].transpose(0, 2, 1)).ravel().take(group).reshape(m, REFINE)
            v += z.take(block, axis=0)
            np.minimum(v, _SUREST, out=v)
            np.maximum(v, -_SUREST, out=v)
            q = _chance(v)  # probability of the turn that was taken
            total[at : at + m] += np.log(q).sum(axis=1)
            err = np.zeros((m, REFINE, GROUPS), np.float32)
            err.ravel()[group] = np.subtract(1, q, out=q).ravel()
            more = err.transpose(0, 2, 1) @ x
            more[:, :, INPUTS:] = 0
            more *= step
            w[:m] += more
    total -= (REFINE * steps - size[order]) * float(np.log(_chance(np.array([_SUREST])))[0])
    out = np.empty(len(size))
    out[order] = total / np.log(10)
    back = np.empty((len(size), GROUPS, INPUTS), np.float32)
    back[order] = own[:, :, :INPUTS] * np.float32(SCALE)
    return out, back
