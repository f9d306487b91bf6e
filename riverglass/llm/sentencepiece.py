"""Operator 4: SentencePiece encoding and decoding, with sampled segmentations by Gumbel top-k without replacement.

``encode`` and ``decode`` are the tokenizer itself. ``sample_segmentations`` draws ``k`` distinct segmentations of a
whole text: the lattice of all its segmentations into pieces is searched best first, where the priority of a partial
segmentation is the perturbed log-probability (Gumbel noise added) of the best complete one below it. Backward
log-sums over the lattice make that bound exact, so the first ``k`` complete segmentations leave the queue in the
order of a draw without replacement. A partial segmentation that left the queue is completed step by step, and at each step
the rejected alternatives enter the queue as one group, with noise below that of the chosen one. Noise is a hash of the row key, the path and the place in the
text, so a row's samples depend on nothing else. Each sample comes with its log-probability and inclusion score, the
probability that its noise exceeds the next perturbed value after the ``k`` drawn.

The vocabulary's merge ranks give the piece probabilities (Zipf: 1 / (rank + 10), raised to ``alpha``); a character
without a piece falls back to its UTF-8 bytes. Pieces never reach across the start of a word (nor, where the vocabulary has none
that does, from a letter to another character), so the lattice of a text is a chain of word lattices, and a word's lattice is kept from batch to batch. Texts are taken whole, whatever their length; a longer
one than half a million characters is a batch of its own.

Defined cases: a null text is treated as empty; an empty text has one segmentation, without pieces, of probability 1; a text with fewer than ``k``
segmentations yields all of them, with inclusion score 1; U+2581 in a text is read as a space, as the tokenizer does;
a null row key hashes as the empty string; repeated rows get the same samples; very long texts are
sampled whole; an empty table gives an empty one; of other columns none is read, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_MARK = "▁"
_RUNS = re.compile(f"{_MARK}*[^{_MARK}]+|{_MARK}+")
_LETTER = r"[^\W\d_]"
_FINE = re.compile(rf"{_MARK}*{_LETTER}+|{_MARK}*(?:[^\w{_MARK}]|[\d_])+|{_MARK}+")
_CROSSING = re.compile(rf"{_LETTER}(?:[^\w{_MARK}]|[\d_])|(?:[^\w{_MARK}]|[\d_]){_LETTER}")
_M = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = 42  # hashes are looked up by their top 22 bits first
_LOADED: dict[int, object] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces by hash, with log-probabilities; bytes of the model file in."""

    def __init__(self, model: bytes, alpha: float = 1.0):
        self.sp = sp = sentencepiece.SentencePieceProcessor()
        sp.LoadFromSerializedProto(model)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        rank = np.array([min(-sp.get_score(i), sp.get_piece_size()) for i in ids])
        logp = -np.log(np.maximum(rank, 0) + 10)
        logp = alpha * (logp - np.log(np.exp(logp).sum()))
        self.longest = max(map(len, pieces))
        self.byte0 = sp.piece_to_id("<0x00>")
        self.byte_logp = float(logp.min()) - alpha * np.log(256)
        h = np.array([self.hash(p) for p in pieces], np.uint64)
        order = np.argsort(h)
        self.hashes, self.ids, self.logp = h[order], np.array(ids, np.int32)[order], logp[order]
        self.starts = np.zeros(1 << (64 - _SHIFT), np.uint8)  # by hash: 1 if a longer piece may begin so, 2 if it may be a piece
        prefixes = {p[:n] for p in pieces for n in range(1, len(p))}
        self.starts[(np.array([self.hash(p) for p in prefixes], np.uint64) >> np.uint64(_SHIFT)).astype(np.int64)] = 1
        self.starts[(self.hashes >> np.uint64(_SHIFT)).astype(np.int64)] |= 2
        spelt = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).encode() for i in range(sp.get_piece_size())]
        self.spelling, self.spelt_len = np.frombuffer(b"".join(spelt), np.uint8), np.array([len(x) for x in spelt])
        self.spelt_at = np.cumsum(self.spelt_len) - self.spelt_len
        # where no piece joins a letter to another character, words fall apart into runs of either
        self.units = _RUNS if any(map(_CROSSING.search, pieces)) else _FINE
        self.lattices = Lattices(self)

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes of the pieces, one after another."""
        n = self.spelt_len[ids]
        ends = np.cumsum(n)
        return self.spelling[np.repeat(self.spelt_at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_M) + ord(c) + 1) & (2**64 - 1)
        return h


class Lattices:
    """Word lattices: row (end of a word) holds the edges that start where it starts, by length.

    What follows a place in a word decides its edges, so words with one ending share its rows: ``row_at`` holds the row
    of every (word, distance from its end). Words stay between batches, as a corpus repeats most of them; beyond ``room`` rows the most used half of it stays.
    Probabilities are conditional on the row and kept as logarithms, so that an alternative of any mass is queued; the
    cumulated ones serve the walk only, which draws with 24 bits.
    """

    def __init__(self, vocab: Vocabulary, room: int = 1 << 18):
        self.vocab, self.room, self.wide = vocab, room, vocab.longest
        self.names: dict[str, int] = {}
        self.size, self.start, self.uses, self.rows = (*np.zeros((3, 0), np.int64), 0)
        self.row_at = np.empty(0, np.int32)
        self.cum, self.logp, self.ids = (np.empty((0, self.wide), t) for t in (np.float32, np.float32, np.int32))
        self.used = np.empty(0, np.int32)  # columns of logp and ids that a row has filled

    def look_up(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The words of each text by number."""
        words = set().union(*texts)
        new = [w for w in words if w not in self.names]
        if self.rows + sum(map(len, new)) > self.room and self.rows > self.room // 2:
            self._forget()
            new = [w for w in words if w not in self.names]
        if new:
            self._build(new)
        found = np.fromiter(map(self.names.__getitem__, itertools.chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        self.uses += np.bincount(found, minlength=len(self.uses))
        return np.split(found, np.cumsum([len(t) for t in texts])[:-1])

    def _forget(self) -> None:
        order = np.argsort(-self.uses, kind="stable")
        room = self.room // 2 * len(self.row_at) // self.rows  # in characters, of which several share a row
        kept = np.sort(order[np.cumsum(self.size[order]) <= room])
        words, size, cells = list(self.names), self.size[kept], self.row_at[self._places(kept)]
        needed = np.zeros(self.rows, bool)
        needed[cells] = True
        rows = np.flatnonzero(needed)
        self.row_at, self.rows = (np.cumsum(needed, dtype=np.int32) - 1)[cells], len(rows)
        for name in ("cum", "logp", "ids", "used"):
            setattr(self, name, getattr(self, name)[rows])
        self.names = {words[i]: j for j, i in enumerate(kept.tolist())}
        self.size, self.start, self.uses = size, np.cumsum(size) - size, self.uses[kept]

    def _places(self, words: np.ndarray) -> np.ndarray:
        """Where in ``row_at`` the words' rows are, one word after another."""
        size = self.size[words]
        ends = np.cumsum(size)
        return np.repeat(self.start[words] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)

    def _grow(self, rows: int) -> None:
        if rows > len(self.cum):
            room = max(rows, min(2 * len(self.cum), self.room), 1 << 12)
            for name in ("cum", "logp", "ids", "used"):
                old = getattr(self, name)
                now = np.empty((room, *old.shape[1:]), old.dtype)
                now[: self.rows] = old[: self.rows]
                setattr(self, name, now)

    def _build(self, words: list[str]) -> None:
        vocab, size, base = self.vocab, np.fromiter(map(len, words), np.int64, len(words)), len(self.row_at)
        ends, flat = np.cumsum(size), np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        tails = [np.where(size >= d, flat[np.maximum(ends - d, 0)], 0) for d in range(6, 0, -1)]
        order = np.lexsort(tails)  # words with one ending become neighbours
        words, size, ends = [words[i] for i in order.tolist()], size[order], ends[order]
        start = base + np.cumsum(size) - size
        self.names.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.size, self.start, self.uses = np.concatenate((self.size, size)), np.concatenate((self.start, start)), np.concatenate((self.uses, 0 * size))
        self.row_at = np.concatenate((self.row_at, np.empty(len(flat), np.int32)))
        self._grow(self.rows + len(flat))
        beta, chars = [np.zeros(1)], [None]  # by distance and ending: log-sums, and the characters there
        live, ending = np.arange(len(size)), np.zeros(len(size), np.int64)  # words of at least d characters, and their endings of d - 1
        above: list[np.ndarray] = []  # by shorter length, the last 16 of them: each ending's own ending
        for d in range(1, int(size.max()) + 1):
            long = size[live] >= d
            live, ending = live[long], ending[long]
            c = flat[ends[live] - d]
            new = np.ones(len(live), bool)
            new[1:] = (ending[1:] != ending[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(new)
            shorter, n = ending[first], len(first)
            above = [shorter, *(x[shorter] for x in above[: self.wide - 1])]
            ending = np.cumsum(new) - 1
            chars.append(c[first].astype(np.uint64))
            at = np.arange(self.rows, self.rows + n)
            self.rows += n
            self.row_at[start[live] + d - 1] = at[ending]
            values: list[np.ndarray | None] = [None] * min(self.wide, d)  # by length, where any ending has such a piece
            open_ = np.arange(n)  # endings whose characters so far begin some piece
            h = np.zeros(n, np.uint64)
            for length in range(1, len(values) + 1):
                with np.errstate(over="ignore"):
                    h = h * _M + (chars[d - length + 1][above[length - 2][open_] if length > 1 else open_] + np.uint64(1))
                kind = vocab.starts[(h >> np.uint64(_SHIFT)).astype(np.int64)]
                maybe = np.flatnonzero(kind & 2)
                if len(maybe):
                    hm = h[maybe]
                    hit = np.searchsorted(vocab.hashes, hm).clip(max=len(vocab.hashes) - 1)
                    true = np.flatnonzero(vocab.hashes[hit] == hm)
                    if len(true):
                        maybe, hit = open_[maybe[true]], hit[true]
                        values[length - 1] = found = np.full(n, -np.inf)
                        found[maybe] = vocab.logp[hit] + beta[d - length][above[length - 1][maybe]]
                        self.ids[at[maybe], length - 1] = vocab.ids[hit]
                on = np.flatnonzero(kind & 1)
                open_, h = open_[on], h[on]
                if not len(open_):
                    break
            if values[0] is None:
                values[0] = np.full(n, -np.inf)
            lone = np.flatnonzero(values[0] == -np.inf)
            if len(lone):
                c = chars[d][lone].astype(np.int64)
                n_bytes = 1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF)
                values[0][lone] = n_bytes * vocab.byte_logp + beta[d - 1][above[0][lone]]
                self.ids[at[lone], 0] = np.where(c > 0x7F, -2 - c, vocab.byte0 + c)  # one byte, or to be spelt in bytes
            there = [j for j, v in enumerate(values) if v is not None]
            used = there[-1] + 1
            top = values[0]
            for j in there[1:]:
                top = np.maximum(top, values[j])
            e = {j: np.exp(values[j] - top) for j in there}
            total = sum(e.values())
            log_total = top + np.log(total)
            beta.append(log_total)
            cum, logp = np.ones((n, self.wide), np.float32), np.full((n, used), -np.inf, np.float32)
            so_far = np.zeros(n)
            for j in range(used):
                if j in e:
                    so_far = so_far + e[j] / total
                    logp[:, j] = values[j] - log_total
                cum[:, j] = np.where(so_far > 1 - 2.0**-24, 1.0, so_far)
            self.cum[at], self.logp[at, :used], self.used[at] = cum, logp, used

    def edges(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and log-probabilities of the edges of a row."""
        logp = self.logp[row, : self.used[row]]
        n = np.flatnonzero(logp > -np.inf)
        return n + 1, logp[n]

    def others(self, cells: np.ndarray) -> np.ndarray:
        """Log-masses of all other edges of the cells' rows."""
        row, col = cells // self.wide, cells % self.wide
        p = np.where(np.arange(self.wide) < self.used[row][:, None], self.logp[row], -np.inf)
        p[np.arange(len(cells)), col] = -np.inf
        top = p.max(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(top > -np.inf, top + np.log(np.exp(p - top[:, None]).sum(axis=1)), -np.inf).astype(np.float64)

    def walk(self, word: np.ndarray, left: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Complete words from ``left`` characters before their ends: (index of the word, edge cell), in order."""
        owner, cells, index, base = [], [], np.arange(len(word)), self.start[word] - 1
        cum, steps = self.cum.reshape(-1), [1 << b for b in reversed(range((self.wide - 1).bit_length()))]
        while True:
            alive = np.flatnonzero(left > 0)
            if not len(alive):
                break
            if len(alive) < len(left):
                base, left, noise, index = base[alive], left[alive], noise[alive], index[alive]
            with np.errstate(over="ignore"):
                u = (_mix(noise + left.astype(np.uint64) * _M) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
            row = self.row_at[base + left].astype(np.int64) * self.wide
            cell = row - 1  # binary search for the first cell whose cumulated probability is above u
            for step in steps:
                further = np.minimum(cell + step, row + self.wide - 1)
                cell = np.where(cum[further] <= u, further, cell)
            cell += 1
            owner.append(index)
            cells.append(cell)
            left = left - (cell - row) - 1
        if not owner:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner, cells = np.concatenate(owner), np.concatenate(cells)
        order = np.argsort(owner, kind="stable")
        return owner[order], cells[order]


def _words(text: str, units: re.Pattern = _RUNS) -> list[str]:
    """The marked words whose lattices form the text's; joined, they are the text as the tokenizer sees it."""
    return units.findall(_MARK + text.replace(" ", _MARK)) if text else []


class _Draw:
    """The search of one text: its paths as edge cells, and the queue of groups of rejected edges."""

    __slots__ = ("key", "queue", "paths", "found", "ticks")

    def __init__(self, key: int):
        self.key, self.queue, self.paths, self.found, self.ticks = key, [], [], [], 0

    def unit(self) -> float:
        """The next number of this text's noise, above 0 and at most 1."""
        self.ticks += 1
        return _unit_of(self.key, self.ticks)


_REACH = -np.log(2.0**-53)  # no noise below a group exceeds its log-mass by more
_CHUNK = 96


def _unit_of(key: int, tick: int) -> float:
    """``_unit`` of two whole numbers."""
    x, full = key + int(_M), 2**64 - 1
    for add in (tick * int(_M), 0):
        x &= full
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        x = (x ^ (x >> 31)) + add
    return ((x >> 11) + 1) * 2.0**-53


def _unit(key: np.ndarray, tick: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((_mix(_mix(key + _M) + tick * _M) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def _gumbel_below(top, mass, unit):
    """Gumbel noise at log-masses, given that it is below ``top``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-top, np.log(-np.log(unit)) - mass)


def sample(vocab: Vocabulary, texts: list[str | None], keys: list[int], k: int = 2) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to ``k`` of (piece ids, log-probability, perturbed value, inclusion score)."""
    if not texts:
        return []
    lattices = vocab.lattices
    types = lattices.look_up([_words(t or "", vocab.units) for t in texts])
    draws = [_Draw(k_) for k_ in keys]
    todo: list[tuple[int, int, int, int, np.ndarray, float, float]] = []  # text, word, characters left in it, steps kept, cells kept, log-mass, perturbed
    for i, d in enumerate(draws):
        first = -float(np.log(-np.log(d.unit() - 2.0**-54)))
        todo.append((i, 0, int(lattices.size[types[i][0]]) if len(types[i]) else 0, 0, np.zeros(0, np.int64), 0.0, first))
    while todo:
        word, left, noise, spans = [], [], [], []
        for i, w, rest, _, _, _, _ in todo:
            t = types[i][w:]
            n = lattices.size[t]
            if len(t):
                n[0] = rest
            word.append(t)
            left.append(n)
            with np.errstate(over="ignore"):
                noise.append(np.uint64(draws[i].key) + (np.arange(w, w + len(t), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) + np.uint64(len(draws[i].paths) * 0x2545F4914F6CDD1D & (2**64 - 1)))
            spans.append(len(t))
        owner, cells = lattices.walk(np.concatenate(word), np.concatenate(left), np.concatenate(noise))
        bounds = np.searchsorted(owner, np.concatenate(([0], np.cumsum(spans))))
        fresh = []
        for j, (i, _, _, kept, before, mass, perturbed) in enumerate(todo):
            path = np.concatenate((before, cells[bounds[j] : bounds[j + 1]]))
            draws[i].paths.append(path)
            draws[i].found.append(perturbed)
            fresh.append((draws[i], path, kept, mass, perturbed))
        _enter(lattices, fresh, k)
        again = [i for i, *_ in todo if len(draws[i].found) < k and draws[i].queue]
        todo = [_branch(lattices, draws[i], i, types[i]) for i in again]
    return _results(vocab, draws)


def _enter(lattices: Lattices, fresh: list[tuple[_Draw, np.ndarray, int, float, float]], k: int) -> None:
    """Queue the rejected edges of new paths, as far as any of them can still be drawn."""
    while fresh := [(d, path, at, mass, top) for d, path, at, mass, top in fresh if at < len(path) and mass + _REACH >= _floor(d, k)]:
        parts = [path[at : at + _CHUNK] for _, path, at, _, _ in fresh]
        sizes = np.array([len(p) for p in parts])
        ends, cells = np.cumsum(sizes), np.concatenate(parts)
        spread = lambda values, kind=np.float64: np.repeat(np.array(values, kind), sizes)  # noqa: B023, E731
        logp = lattices.logp.reshape(-1)[cells].astype(np.float64)
        sums = np.cumsum(logp)
        after = sums - np.repeat(sums[ends - sizes] - logp[ends - sizes], sizes) + spread([f[3] for f in fresh])
        before = after - logp
        which, step = spread(range(len(fresh)), np.int64), np.arange(len(cells)) - np.repeat(ends - sizes, sizes) + spread([f[2] for f in fresh], np.int64)
        tick = (step.astype(np.uint64) << np.uint64(16)) + spread([len(f[0].paths) << 8 for f in fresh], np.uint64)
        value = _gumbel_below(spread([f[4] for f in fresh]), before + lattices.others(cells), _unit(spread([f[0].key for f in fresh], np.uint64), tick))
        order = np.lexsort((-value, which))
        order = order[np.arange(len(order)) - (ends - sizes)[which[order]] <= k]  # those drawn next, and one more for the inclusion score
        order = order[value[order] > -np.inf]
        for j, v, s, m, c in zip(which[order].tolist(), value[order].tolist(), step[order].tolist(), before[order].tolist(), cells[order].tolist(), strict=True):
            heapq.heappush(fresh[j][0].queue, (-v, len(fresh[j][0].paths) - 1, s, m, (c,)))
        fresh = [(d, path, at + _CHUNK, mass, top) for (d, path, at, _, top), mass in zip(fresh, after[ends - 1].tolist(), strict=True)]


def _floor(d: _Draw, k: int) -> float:
    """What a group must reach to matter: the queue holds enough that are above it."""
    need = k + 1 - len(d.found)
    return -heapq.nsmallest(need, d.queue)[-1][0] if len(d.queue) >= need > 0 else -np.inf if need > 0 else np.inf


def _branch(lattices: Lattices, d: _Draw, i: int, types: np.ndarray) -> tuple:
    """Take the best group of rejected edges from the queue, choose one of them and say how its path goes on."""
    value, name, step, mass, taken = heapq.heappop(d.queue)
    path, wide = d.paths[name], lattices.wide
    row = int(path[step]) // wide
    lengths, logp = lattices.edges(row)
    open_ = ~np.isin(row * wide + lengths - 1, taken)
    lengths, logp = lengths[open_], logp[open_]
    chances = np.cumsum(np.exp(logp - logp.max()))
    choice = min(int(np.searchsorted(chances, d.unit() * chances[-1])), len(logp) - 1)
    cell = row * wide + int(lengths[choice]) - 1
    if len(logp) > 1:
        others = mass + float(np.logaddexp.reduce(np.delete(logp, choice)))
        heapq.heappush(d.queue, (-float(_gumbel_below(-value, others, d.unit())), name, step, mass, (*taken, cell)))
    used = int((path[:step] % wide + 1).sum() + lengths[choice])
    ends = np.cumsum(lattices.size[types])
    w = int(np.searchsorted(ends, used, side="right"))
    rest = int(ends[w] - used) if w < len(types) else 0
    return i, w, rest, step + 1, np.concatenate((path[:step], [cell])), mass + float(logp[choice]), -value


def _results(vocab: Vocabulary, draws: list[_Draw]) -> list[list[tuple[np.ndarray, float, float, float]]]:
    paths = [p for d in draws for p in d.paths]
    cells = np.concatenate(paths)
    sums = np.concatenate(([0.0], np.cumsum(vocab.lattices.logp.reshape(-1)[cells], dtype=np.float64)))
    ends = np.cumsum([len(p) for p in paths]).tolist()
    ids, at, j, out = vocab.lattices.ids.reshape(-1)[cells], 0, 0, []
    for d in draws:
        bound = -d.queue[0][0] if d.queue else -np.inf
        out.append([])
        for perturbed in d.found:
            logp = float(sums[ends[j]] - sums[at])
            score = float(-np.expm1(-np.exp(min(logp - bound, 50.0)))) if d.queue else 1.0
            out[-1].append((_spelt(vocab, ids[at : ends[j]]), logp, perturbed, score))
            at, j = ends[j], j + 1
    return out


def _spelt(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Piece ids, with characters that have no piece spelt in bytes."""
    lone = np.flatnonzero(ids < 0)
    if not len(lone):
        return ids
    parts, at = [], 0
    for i in lone.tolist():
        parts += [ids[at:i], np.frombuffer(chr(-2 - int(ids[i])).encode("utf-8", "replace"), np.uint8).astype(np.int32) + vocab.byte0]
        at = i + 1
    return np.concatenate([*parts, ids[at:]])


def row_key(value: object, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest("" if value is None else str(value), seed)


def _vocabulary(model: bytes, alpha: float) -> Vocabulary:
    key = hash((model, alpha))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(model, alpha)
    return _LOADED[key]


def _release() -> None:
    """Lattices go at the end of a task, as an idle worker keeps what it holds."""
    for vocab in _LOADED.values():
        vocab.lattices = Lattices(vocab)


def _model(spark: SparkSession, path: str):
    """The model file as a broadcast; tokenizer models are of bounded size (here half a megabyte)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def sample_segmentations(docs: DataFrame, k: int = 2, alpha: float = 0.25, seed: int = 0, model: str = MODEL, key: str = "doc_id", digest: bool = False) -> DataFrame:
    """(key, rank, ids, n_pieces, log_prob, inclusion): ``k`` distinct segmentations of every text, best first.

    With ``digest`` the ids are replaced by their SHA-256 over little-endian 32-bit integers, as ids_sha256, and
    ``decodes`` tells whether the pieces spell the text as the tokenizer reads it.
    """
    from hashlib import sha256

    held = _model(docs.sparkSession, model)
    name = "ids_sha256" if digest else "ids"

    def run(batch):
        vocab = _vocabulary(held.value, alpha)
        out = {key: [], "rank": [], name: [], "n_pieces": [], "log_prob": [], "inclusion": [], **({"decodes": []} if digest else {})}
        keys = [row_key(v, seed) for v in batch[key]]
        done = itertools.chain.from_iterable(sample(vocab, batch["text"][a:b], keys[a:b], k) for a, b in _shares(batch["text"]))
        for row, text, found in zip(batch[key], batch["text"], done, strict=True):
            if digest:
                read = (_MARK + text.replace(" ", _MARK)).encode("utf-8", "replace") if text else b""
                out["decodes"] += [vocab.spell(f[0]) == read for f in found]
            for rank, (ids, logp, _, score) in enumerate(found, 1):
                out[key].append(row)
                out["rank"].append(rank)
                out[name].append(sha256(ids.astype("<i4").tobytes()).hexdigest() if digest else ids)
                out["n_pieces"].append(len(ids))
                out["log_prob"].append(logp)
                out["inclusion"].append(score)
        return out

    kind, last = ("ids_sha256 string", ", decodes boolean") if digest else ("ids array<int>", "")
    rows = docs.select(F.col(key).cast("long"), "text")
    return arrow_map(rows, f"{key} long, rank int, {kind}, n_pieces int, log_prob double, inclusion double{last}", run, rows=1024, after=_release)


def _shares(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters, which bounds the lattices held at a time; a longer text is a run of its own."""
    at = total = 0
    for i, text in enumerate(texts):
        if i > at and total + len(text or "") > most:
            yield at, i
            at, total = i, 0
        total += len(text or "")
    yield at, len(texts)


def encode(docs: DataFrame, model: str = MODEL, key: str = "doc_id") -> DataFrame:
    """(key, ids): the tokenizer's own encoding of every whole text."""
    held = _model(docs.sparkSession, model)

    def run(batch):
        sp = _vocabulary(held.value, 1.0).sp
        return {key: batch[key], "ids": sp.encode([t or "" for t in batch["text"]], num_threads=1)}

    return arrow_map(docs.select(F.col(key).cast("long"), "text"), f"{key} long, ids array<int>", run)


def decode(encoded: DataFrame, model: str = MODEL, key: str = "doc_id") -> DataFrame:
    """(key, text): the text of piece ids, those of ``encode`` or of a sampled segmentation."""
    held = _model(encoded.sparkSession, model)

    def run(batch):
        sp = _vocabulary(held.value, 1.0).sp
        return {key: batch[key], "text": sp.decode([x or [] for x in batch["ids"]], num_threads=1)}

    return arrow_map(encoded.select(F.col(key).cast("long"), "ids"), f"{key} long, text string", run)
