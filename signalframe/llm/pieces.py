"""Sampled SentencePiece segmentations without replacement, and their decoding.

A text is a lattice: positions are nodes, vocabulary pieces are edges. A piece's
weight falls with its rank in the vocabulary, ``(rank + 1) ** -power``. Node masses
(log-sums of all completions) make a piece's share at its node its conditional
probability. Gumbel noise perturbs the log-probabilities; the k segmentations with
the largest perturbed values are k draws without replacement. An A-star search
finds them from the left: the perturbed value of a partial path bounds its
completions and its best child keeps that value, so only the best open branch is
ever completed, and the best open branch left at the end is the threshold from
which the inclusion probabilities follow.

No piece crosses the start of a word or a line break, so the lattice of a text is
a chain of word lattices. Those are built once per different word and remembered;
the search walks all words of a batch of texts at a time. Noise is a hash of the
row's key, the word's place, the node and the edge: it does not depend on batches.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SPACE = "▁"
#: Word lattices a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 350_000
_WORDS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
#: Words with more characters than this are walked each by itself: a step of such a
#: word would else be a round of array work for one node.
LONG_WORD = 512
_BATCH = 1 << 19
#: Log-weight of a character outside the vocabulary.
_LONE = -16.0
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: What the j-th edge adds to a node's seed; a character starts at most so many pieces.
_STEPS = np.arange(1, 129, dtype=np.uint64) * _GOLD
_LATTICES: dict[tuple[str, float], "Lattices"] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _exponential(h: np.ndarray) -> np.ndarray:
    u = (h >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    np.log(u, out=u)
    return np.negative(u, out=u)


def _gumbel(h: np.ndarray) -> np.ndarray:
    return -np.log(_exponential(h))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


class _Grow:
    """An array that is appended to."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 12, dtype), 0

    def empty(self):
        self.n = 0

    def add(self, values):
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class _Places(dict):
    """Word -> number; a new word gets the next one and is noted for learning."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = place = len(self)
        return place


def _split(text: str) -> list[str]:
    """Words with the space in front of them; a line break starts a word.

    Single spaces split fast; runs of spaces stay with the word after them.
    """
    if not text:
        return []
    if "  " in text or SPACE in text:
        return _WORDS.findall(SPACE + text.replace(" ", SPACE))
    return (SPACE + text.replace(" ", f" {SPACE}").replace("\n", " \n")).split(" ")


class Lattices:
    """Vocabulary, remembered word lattices and the bytes of every piece."""

    def __init__(self, path: str, power: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.vocab = {pieces[i]: i for i in plain}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.vocab):
            raise ValueError("pieces of this model cross words")
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        self.weight = np.zeros(n)
        self.weight[list(rank)] = -power * np.log(np.array(list(rank.values())) + 1.0)
        self.plain = np.exp(self.weight)
        #: Characters from a word's end whose masses no double underflows.
        self.safe = int(600 / max(-_LONE, -self.weight.min()))
        self._trie()
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        raw = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_len = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.first_node = _Grow(np.int32)
        self.node_edge = _Grow(np.int32)  # first edge of a node
        self.node_edges = _Grow(np.int8)  # number of edges, 0 at a word's end
        self.to, self.piece_at, self.piece_n = _Grow(np.int32), _Grow(np.int32), _Grow(np.int8)
        self.odds = _Grow(np.float64)  # one over an edge's share of its node, its conditional probability
        self.piece = _Grow(np.int32)
        self.forget()

    def forget(self):
        self.places = _Places()
        for grown in (self.first_node, self.node_edge, self.node_edges, self.to, self.odds, self.piece_at, self.piece_n, self.piece):
            grown.empty()

    def _trie(self):
        """The vocabulary as a hash table of ``state * 2**21 + character`` with next states, and the states' pieces.

        A key lies at its hash or in one of the places after it, before the first free one.
        """
        state_of, step = {"": 0}, {}
        for piece in self.vocab:
            for k in range(len(piece)):
                if piece[: k + 1] not in state_of:
                    state_of[piece[: k + 1]] = len(state_of)
                step[state_of[piece[:k]] << 21 | ord(piece[k])] = state_of[piece[: k + 1]]
        bits = max(4, (4 * len(step)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.step_key, self.step_to = np.full((1 << bits) + len(step), -1, np.int64), np.zeros((1 << bits) + len(step), np.int64)
        key, to = np.array(list(step), np.int64), np.array(list(step.values()), np.int64)
        spot = self._spot(key)
        while len(key):
            free = self.step_key[spot] < 0
            self.step_key[spot[free]], self.step_to[spot[free]] = key[free], to[free]
            out = self.step_key[spot] != key  # taken, or another one came to the same place
            key, to, spot = key[out], to[out], spot[out] + 1
        self.piece_of = np.full(len(state_of), -1, dtype=np.int64)
        self.piece_of[[state_of[p] for p in self.vocab]] = list(self.vocab.values())

    def _spot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _GOLD) >> self.shift).astype(np.int64)

    def _step(self, key: np.ndarray) -> np.ndarray:
        """Next state of every key, -1 if there is none."""
        spot = self._spot(key)
        there = self.step_key[spot]
        to = np.where(there == key, self.step_to[spot], -1)
        far = np.flatnonzero((there != key) & (there >= 0))
        while len(far):
            spot[far] += 1
            there = self.step_key[spot[far]]
            hit = there == key[far]
            to[far[hit]] = self.step_to[spot[far[hit]]]
            far = far[~hit & (there >= 0)]
        return to

    def learn(self, words: list[str]):
        """Add the lattices of new different words, all at once, in the order of their numbers.

        Every position follows the vocabulary's trie one character at a time, as
        long as some piece goes on; masses run from the words' ends backwards.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # characters from here to the word's end
        live, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        found, count = [], np.zeros(len(chars), np.int64)
        n = 0

        def add(at, length, piece):  # at most one of a length at a place: the shorter ones come first
            found.append((at, count[at], length, piece))
            count[at] += 1

        while len(live):
            state = self._step(state << 21 | chars[live + n])
            ok = state >= 0
            live, state = live[ok], state[ok]
            n += 1
            piece = self.piece_of[state]
            hit = piece >= 0
            if n == 1:  # a character that is no piece is spelled in bytes
                lone = np.ones(len(chars), bool)
                lone[live[hit]] = False
                add(np.flatnonzero(lone), 1, -1)
            add(live[hit], n, piece[hit])
            more = left[live] > n
            live, state = live[more], state[more]
        start = np.cumsum(count) - count
        at = np.repeat(np.arange(len(chars)), count)
        length, piece = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for some, before, size, which in found:
            slot = start[some] + before
            length[slot], piece[slot] = size, which
        node = np.arange(len(chars)) + word  # each word has one node more than characters
        source, target = node[at], node[at] + length
        weight = np.where(piece >= 0, self.weight[piece], _LONE)
        size = np.where(piece >= 0, self.plain[piece], math.exp(_LONE))
        # Masses near the words' ends as they are, farther off as logarithms.
        safe = min(self.safe, LONG_WORD)
        near = np.flatnonzero(left <= LONG_WORD)
        by_left = near[np.argsort(left[near].astype(np.uint16 if LONG_WORD < 1 << 16 else np.int64), kind="stable")]
        cuts = np.r_[0, np.cumsum(np.bincount(left[near])[1:])] if len(near) else np.zeros(1, int)
        plain, mass = np.ones(len(chars) + len(words)), None
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            here = by_left[a:b]
            edge = _ragged(start[here], count[here])
            seg = np.cumsum(count[here]) - count[here]
            if k < safe:
                plain[node[here]] = np.add.reduceat(size[edge] * plain[target[edge]], seg)
                continue
            if mass is None:
                mass = np.log(plain)
            ways = weight[edge] + mass[target[edge]]
            top = np.maximum.reduceat(ways, seg)
            mass[node[here]] = top + np.log(np.add.reduceat(np.exp(ways - np.repeat(top, count[here])), seg))
        odds = plain[source] / (size * plain[target])
        if mass is None and (sizes > LONG_WORD).any():
            mass = np.log(plain)
        for w in np.flatnonzero(sizes > LONG_WORD):
            self._far_masses(mass, node, count, start, weight, target, int(sizes[:w].sum()), int(sizes[w]))
        if mass is not None:
            far = np.flatnonzero((left > safe)[at])
            odds[far] = np.exp(mass[source[far]] - weight[far] - mass[target[far]])
        node0, edge0, piece0 = self.node_edge.n, self.to.n, self.piece.n
        self.first_node.add(node0 + np.cumsum(sizes + 1) - sizes - 1)
        edges = np.zeros(len(plain), np.int64)
        edges[node] = count
        self.node_edge.add(edge0 + np.cumsum(edges) - edges)
        self.node_edges.add(edges)
        self.to.add(node0 + target)
        self.odds.add(odds)
        odd = np.flatnonzero(piece < 0)
        n_ids = np.ones(len(piece), np.int64)
        spell = {int(c): [self.byte_ids[x] for x in chr(c).encode("utf-8", "replace")] for c in np.unique(chars[at[odd]])}
        n_ids[odd] = [len(spell[c]) for c in chars[at[odd]].tolist()]
        where = np.cumsum(n_ids) - n_ids
        flat = np.zeros(int(n_ids.sum()), np.int32)
        flat[where] = piece
        for c, ids in spell.items():
            rows = where[odd[chars[at[odd]] == c]]
            flat[rows[:, None] + np.arange(len(ids))] = ids
        self.piece_at.add(piece0 + where)
        self.piece_n.add(n_ids)
        self.piece.add(flat)

    @staticmethod
    def _far_masses(mass, node, count, start, weight, target, at, size):
        """Masses of a long word's positions beyond the last ``LONG_WORD``, one after another."""
        first, edge0, edge1 = int(node[at]), int(start[at]), int(start[at + size - 1] + count[at + size - 1])
        own, w, to = mass[first : first + size + 1].tolist(), weight[edge0:edge1].tolist(), (target[edge0:edge1] - first).tolist()
        n, s = count[at : at + size].tolist(), (start[at : at + size] - edge0).tolist()
        for i in range(size - LONG_WORD - 1, -1, -1):
            ways = [w[e] + own[to[e]] for e in range(s[i], s[i] + n[i])]
            top = max(ways)
            own[i] = top + math.log(sum(math.exp(x - top) for x in ways))
        mass[first : first + size + 1] = own

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Remembered places of each text's words."""
        if len(self.places) > REMEMBERED:
            self.forget()
        get = self.places.__getitem__
        out = []
        for text in texts:
            words = _split(text)
            out.append(np.fromiter(map(get, words), np.int64, len(words)))
        if self.places.new:
            self.learn(self.places.new)
            self.places.new = []
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the pieces, without the space that encoding puts in front."""
        return self.raw[_ragged(self.raw_at[ids], self.raw_len[ids])].tobytes()[1:] if len(ids) else b""

    # -- search ---------------------------------------------------------------

    def walk(self, word: np.ndarray, node: np.ndarray, row: np.ndarray, place: np.ndarray, key: np.ndarray):
        """Best perturbed path through every word, from ``node`` on.

        Returns the path's edges in order, per step the time from the first to the second
        edge of its node (``_edge_times``), each word's first step and the seed of its noise.
        """
        first, edge_at, edge_n, to, odds = self.first_node.data, self.node_edge.data, self.node_edges.data, self.to.data, self.odds.data
        # Words in the order of their numbers: what is read of the lattices lies close.
        order = np.argsort(word)
        seeds_of = key[row] + (place.astype(np.uint64) << np.uint64(24)) - first[word].astype(np.uint64)
        word, node, seeds = word[order], node[order].astype(np.int64), seeds_of[order]
        ends = np.r_[first[1 : self.first_node.n], self.node_edge.n][word] - 1
        alone = ends - node > LONG_WORD
        live = np.flatnonzero((edge_n[node] > 0) & ~alone)
        steps = np.zeros(len(word), np.int64)
        taken = []
        for i in np.flatnonzero(alone):
            steps[i] = self._walk_alone(i, int(node[i]), int(ends[i]), seeds[i : i + 1], taken)
        t = 0
        while len(live):
            # Nodes with many edges first: the j-th edges of all that have one lie in front.
            fan = edge_n[node[live]]
            live = live[np.argsort(-fan, kind="stable")]
            at = node[live]
            having = np.cumsum(np.bincount(fan)[::-1])[::-1].tolist()
            start = edge_at[at].astype(np.int64)
            seed = _mix(seeds[live] + at.astype(np.uint64))
            one, two, pick = np.zeros(len(live)), np.full(len(live), np.inf), start.copy()
            if len(having) > 2:  # a node with one edge draws nothing
                one[: having[2]] = np.inf
            for j in range(len(having) - 1 if len(having) > 2 else 0):
                m = having[max(j + 1, 2)]
                edge = start[:m] + j
                time_ = _exponential(_mix(seed[:m] + _STEPS[j]))
                time_ *= odds[edge]
                a, b = one[:m], two[:m]
                np.copyto(pick[:m], edge, where=time_ < a)  # equal noise: the first edge
                np.minimum(b, np.maximum(a, time_), out=b)
                np.minimum(a, time_, out=a)
            two -= one
            taken.append((live, t, pick, two))
            steps[live] += 1
            now = to[pick]
            node[live] = now
            live = live[edge_n[now] > 0]
            if len(live) * 16 < len(word):
                live.sort()
            else:
                on = np.zeros(len(word), bool)
                on[live] = True
                live = np.flatnonzero(on)
            t += 1
        offset = np.zeros(len(word), np.int64)
        offset[order] = steps
        offset = np.cumsum(offset) - offset
        mine = offset[order]
        path, gap = np.zeros(int(steps.sum()), np.int64), np.zeros(int(steps.sum()))
        for who, t, pick, more in taken:
            where = mine[who] + t
            path[where], gap[where] = pick, more
        return path, gap, offset, seeds_of

    def _walk_alone(self, i, begin, end, seed, taken) -> int:
        """The same for one long word: the noise of all its nodes at once, then the best edges one after another."""
        at = np.arange(begin, end)
        edge, owner, times = self._edge_times(at, seed)
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        one = np.minimum.reduceat(times, start)
        hits = np.flatnonzero(times == one[owner])
        hits = hits[np.r_[True, owner[hits][1:] != owner[hits][:-1]]]  # equal noise: the first edge
        times[hits] = np.inf
        two = np.minimum.reduceat(times, start)
        follow, path, now = (self.to.data[edge[hits]] - begin).tolist(), [], 0
        while now < len(at):
            path.append(now)
            now = follow[now]
        path = np.array(path)
        taken.append((np.full(len(path), i), np.arange(len(path)), edge[hits[path]], (two - one)[path]))
        return len(path)

    def _edge_times(self, at: np.ndarray, seed: np.ndarray):
        """All edges of some nodes, the nodes' places and the edges' times.

        A time is ``exp(-noisy)`` of an edge's Gumbel-perturbed share, an exponential
        draw over its probability: the least one wins.
        """
        n = self.node_edges.data[at].astype(np.int64)
        edge = _ragged(self.node_edge.data[at].astype(np.int64), n)
        owner = np.repeat(np.arange(len(at)), n)
        j = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n) + 1
        seed = _mix(seed + at.astype(np.uint64))
        return edge, owner, _exponential(_mix(seed[owner] + j.astype(np.uint64) * _GOLD)) * self.odds.data[edge]

    def sample(self, texts: list[str], keys: np.ndarray, k: int):
        """Per text the list of ``(edges, log_prob, value)`` of up to ``k`` draws, and the threshold."""
        words = self.words(texts)
        gumbel = _gumbel(_mix(keys + np.uint64(1)))
        done = [[] for _ in texts]
        open_ = [[] for _ in texts]
        # A job completes a branch: row, words left, first node, edges, log-probability and value so far.
        jobs = [(r, 0, None, np.zeros(0, np.int64), 0.0, gumbel[r]) for r in range(len(texts))]
        for draw in range(k):
            sizes = [len(words[r]) - w for r, w, *_ in jobs]
            cut = np.r_[0, np.cumsum(sizes)].astype(np.int64)
            word = np.concatenate([words[r][w:] for r, w, *_ in jobs])
            place = np.concatenate([np.arange(w, len(words[r])) for r, w, *_ in jobs])
            row = np.repeat(np.arange(len(jobs)), sizes)
            node = self.first_node.data[word]
            for j, (_, _, start, *_) in enumerate(jobs):
                if start is not None and sizes[j]:
                    node[cut[j]] = start
            key = _mix(keys[[j[0] for j in jobs]] + np.array(draw + 2, np.uint64).reshape(1) * _GOLD)
            path, gap, offset, seeds = self.walk(word, node, row, place, key)
            ends = np.r_[offset, len(path)][cut]
            prob = -np.log(self.odds.data[path])
            branches = self._branches(path, gap, offset, node, seeds, prob, ends, [j[4:] for j in jobs], k - draw)
            for j, (r, w, start, edges, phi, val) in enumerate(jobs):
                a, b = ends[j], ends[j + 1]
                done[r].append((np.concatenate([edges, path[a:b]]), phi + float(prob[a:b].sum()), float(val)))
                for v, step, who, edge, phi_there in branches[j]:
                    lead = np.concatenate([edges, path[a:step]])
                    heapq.heappush(open_[r], (-v, len(done[r]), step, edge, lead, int(place[who]), phi_there))
            jobs = []
            for r in range(len(texts)):
                if len(done[r]) == draw + 1 and open_[r] and draw + 1 < k:
                    v, _, _, edge, lead, w, phi = heapq.heappop(open_[r])
                    nxt = int(self.to.data[edge])
                    jobs.append((r, w, nxt, np.r_[lead, edge], phi, -v))
            if not jobs:
                break
        return done, [-o[0][0] if o else -math.inf for o in open_]

    def _branches(self, path, gap, offset, node, seeds, prob, ends, so_far, most):
        """The ``most`` best branches not taken of each job: perturbed value, step, word, edge, log-probability with the edge.

        Conditional Gumbel: the largest child keeps the parent's value T, another one gets
        ``-log(exp(-T) + (time - least time) / P(prefix))``. It falls with the last term, so
        only the steps whose second edges have the least ones can hold a job's best branches.
        """
        found = [[] for _ in so_far]
        total = np.cumsum(prob)
        with np.errstate(divide="ignore"):
            late = np.log(gap) - (total - prob)
        steps, jobs = [], []
        for j, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            best = a + (np.argpartition(late[a:b], most - 1)[:most] if b - a > most else np.arange(b - a))
            steps.append(best)
            jobs.append(np.full(len(best), j))
        steps, jobs = np.concatenate(steps), np.concatenate(jobs)
        word = np.searchsorted(offset, steps, side="right") - 1  # behind words without a step
        at = np.where(steps > offset[word], self.to.data[path[steps - 1]], node[word]) if len(steps) else steps
        edge, owner, times = self._edge_times(at, seeds[word])
        taken = edge == path[steps[owner]]
        behind = times - times[taken][owner]
        edge, step, job, who, gap = (x[~taken] for x in (edge, steps[owner], jobs[owner], word[owner], behind))
        phi = np.array([p for p, _ in so_far])[job] + (total - prob)[step] - np.r_[0.0, total][ends[:-1]][job]
        value = np.array([v for _, v in so_far])[job]
        with np.errstate(divide="ignore"):
            value = -np.logaddexp(-value, np.log(gap) - phi)
        phi = phi - np.log(self.odds.data[edge])
        for i in np.lexsort((edge, step, -value)).tolist():
            mine = found[job[i]]
            if len(mine) < most:
                mine.append((float(value[i]), int(step[i]), int(who[i]), int(edge[i]), float(phi[i])))
        return found


def lattices(path: str, power: float) -> Lattices:
    if (path, power) not in _LATTICES:
        _LATTICES[path, power] = Lattices(path, power)
    return _LATTICES[path, power]


_SCHEMA = "doc_id long, draw int, n_pieces int, log_prob double, value double, log_inclusion double, ids array<int>, decoded boolean"


def _slices(sizes: list[int]):
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= _BATCH:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _log_inclusion(log_prob: float, threshold: float) -> float:
    """Log of ``1 - exp(-exp(log_prob - threshold))``; long texts' probabilities are below any double."""
    if threshold == -math.inf:
        return 0.0
    x = log_prob - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def _segment(path: str, power: float, k: int):
    def run(batches):
        lat = lattices(path, power)
        for batch in batches:
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            keys = batch.column(1).to_numpy().view(np.uint64)
            ids = batch.column(0)
            for a, b in _slices([len(t) for t in raw]):
                texts = [t.decode("utf-8", "replace") for t in raw[a:b]]
                done, threshold = lat.sample(texts, keys[a:b], k)
                cols = [[] for _ in range(6)]
                lists, where = [], []
                for r, draws in enumerate(done):
                    for d, (edges, log_prob, value) in enumerate(draws):
                        out = lat.piece.data[_ragged(lat.piece_at.data[edges].astype(np.int64), lat.piece_n.data[edges].astype(np.int64))]
                        lists.append(out)
                        where.append(a + r)
                        for c, x in zip(cols, (d + 1, len(out), log_prob, value, _log_inclusion(log_prob, threshold[r]), lat.decode(out) == raw[a + r])):
                            c.append(x)
                offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(where)), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()),
                        pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64()), flat, pa.array(cols[5], pa.bool_()),
                    ],
                    [c.split()[0] for c in _SCHEMA.split(", ")],
                )

    return run


def segmentations(docs: DataFrame, model: str, k: int = 2, power: float = 1.0, seed: int = 1) -> DataFrame:
    """Up to ``k`` different segmentations per row, drawn without replacement.

    ``log_prob`` is the segmentation's log-probability, ``value`` its perturbed
    value, ``log_inclusion`` the log of its probability of being among the draws given
    the threshold (0 if the text has no more segmentations), ``decoded`` whether the
    ids spell the text again. A null or empty text has one empty segmentation; a
    character outside the vocabulary becomes its bytes; rows that share a
    ``doc_id`` and a text draw the same; an empty table gives an empty one.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).select("doc_id", key.alias("key"), "text")
    return rows.mapInArrow(_segment(model, power, k), _SCHEMA)
