"""SentencePiece encoding and decoding: n-best segmentation over a public vocabulary's pieces.

No piece has a space after another character, so a text's lattice falls into units, each a run of spaces and what follows up
to the next. Distinct units are searched once: forward Viterbi scores for all of them, side by side; the n-best of a text
change only units whose second-best segmentation costs least, and those are searched backward by A*, the Viterbi scores being
exact estimates of the way that is left.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from facetry.llm.texts import id_type, keyed, map_rows
from facetry.llm.vocabularies import FOLDER, runs

SPACE = "▁"
N_BEST = 4
#: Characters of the longest unit that is searched side by side with others; longer ones are searched alone.
WIDE = 48
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Pieces:
    """Piece strings and scores by id. ``unknown`` is the score of a character without a piece, given as byte pieces from id ``byte`` on."""

    names: list[str]
    scores: list[float]
    byte: int
    unknown: float

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) for i in ids]
        names = [model.id_to_piece(i) if ok else "" for i, ok in zip(ids, plain, strict=True)]
        scores = [model.get_score(i) for i in ids]
        return cls(names, scores, next(i for i in ids if model.is_byte(i)), min(s for s, ok in zip(scores, plain, strict=True) if ok and s > -1e8) - 10.0)


def units_of(text: str) -> list[str]:
    return _UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Lattice:
    """Searches units; keeps what it found for up to ``most`` of them, then for those that were met again."""

    def __init__(self, pieces: Pieces, most: int = 300_000):
        self.pieces, self.most = pieces, most
        self.id_of = {n: i for i, n in enumerate(pieces.names) if n}
        self.longest = max(map(len, self.id_of))
        self.score = np.array(pieces.scores)
        self.raw = [n.encode() if n else b"" for n in pieces.names]
        for b in range(256):
            self.raw[pieces.byte + b] = bytes([b])
        self.tables = self._hash_tables()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.nearest: dict[str, list[tuple[float, np.ndarray, bool]]] = {}
        self.best, self.second, self.start, self.length = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.met = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _keep_common(self) -> None:
        """Forgets the units that were met once; all of them if most were met again."""
        again = np.flatnonzero(self.met > 1)
        names = list(self.known)
        if 2 * len(again) > self.most:
            return self._forget()
        self.known = {names[i]: k for k, i in enumerate(again.tolist())}
        self.nearest = {u: x for u, x in self.nearest.items() if u in self.known}
        self.ids = self.ids[runs(self.start[again], self.length[again])]
        self.best, self.second, self.length, self.met = self.best[again], self.second[again], self.length[again], np.ones(len(again), np.int64)
        self.start = np.cumsum(self.length) - self.length

    def _hash(self, points: np.ndarray) -> np.ndarray:
        """Prefix sums of products; substrings are compared by their difference, brought to place 0."""
        n = points.shape[1]
        self.up = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n, WIDE + 1), _A)))
        self.down = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n, WIDE + 1), np.uint64(pow(int(_A), -1, 1 << 64)))))
        sums = np.zeros((len(points), n + 1), np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _B * self.up[:n], axis=1, out=sums[:, 1:])
        return sums

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * _B
        return h ^ (h >> np.uint64(29))

    def _hash_tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by hash slot; the few pieces whose slot is taken go to a further table."""
        names = list(self.id_of)
        width = max(map(len, names))
        points = matrix(names, width)
        sums = self._hash(points)
        left = self._mixed(sums[np.arange(len(names)), [len(n) for n in names]])
        ids, out = np.array([self.id_of[n] for n in names], np.int64), []
        for shift in (42, 20, 0):
            slot = (left >> np.uint64(shift) & np.uint64((1 << 22) - 1)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            table, check = np.full(1 << 22, -1, np.int32), np.zeros(len(self.score), np.uint64)
            table[slot[first]] = ids[first]
            check[ids[first]] = left[first]
            out.append((shift, table, check))
            rest = np.setdiff1d(np.arange(len(ids)), first)
            left, ids = left[rest], ids[rest]
            if not len(rest):
                return out
        raise ValueError("pieces whose hashes are equal")

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        h, found = self._mixed(h), np.full(h.shape, -1, np.int32)
        for shift, table, check in self.tables:
            i = table[(h >> np.uint64(shift) & np.uint64((1 << 22) - 1)).astype(np.int64)]
            found = np.where((i >= 0) & (check[i] == h), i, found)
        return found

    def _search(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best score, second-best score (-inf: none), number of best ids and these ids, joined, of units of up to WIDE characters."""
        n, width = len(units), max(map(len, units))
        size = np.array([len(u) for u in units])
        points = matrix(units, width)
        sums = self._hash(points)
        most = min(self.longest, width)
        edges = np.full((most, width + 1, n), -1, np.int32)  # by length - 1 and end
        cost = np.full(edges.shape, -np.inf)
        for k in range(1, most + 1):
            found = self._lookup((sums[:, k:] - sums[:, :-k]) * self.down[: width + 1 - k]).T
            found[np.arange(k, width + 1)[:, None] > size] = -1
            edges[k - 1, k:] = found
            cost[k - 1, k:] = np.where(found >= 0, self.score[found], -np.inf)
        bare = (edges[0, 1:] < 0) & (np.arange(1, width + 1)[:, None] <= size)
        edges[0, 1:][bare] = -2
        cost[0, 1:][bare] = self.pieces.unknown
        ahead, back, step = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf), np.zeros((width + 1, n), np.int64)
        ahead[0] = 0.0
        for j in range(1, width + 1):
            for k in range(1, min(most, j) + 1):
                way = ahead[j - k] + cost[k - 1, j]
                better = way >= ahead[j]  # of equal ways that with the longest last piece
                np.copyto(ahead[j], way, where=better)
                step[j][better] = k
        every = np.arange(n)
        back[size, every] = 0.0
        for i in range(width - 1, -1, -1):
            for k in range(1, min(most, width - i) + 1):
                np.maximum(back[i], back[i + k] + cost[k - 1, i + k], out=back[i])
        best = ahead[size, every]
        for k in range(1, most + 1):  # from here on the best way through each piece
            cost[k - 1, k:] += ahead[:-k]
            cost[k - 1, k:] += back[k:]
        at, columns = size.copy(), []
        while (at > 0).any():
            on = np.flatnonzero(at > 0)
            k, here = step[at[on], on], np.full(n, -1, np.int64)
            found = edges[k - 1, at[on], on].astype(np.int64)
            here[on] = np.where(found == -2, -3 - points[on, at[on] - 1].astype(np.int64), found)
            columns.append(here)
            cost[k - 1, at[on], on] = -np.inf  # the second best leaves the best somewhere
            at[on] -= k
        stacked = np.stack(columns[::-1], axis=1)
        second, length, ids = cost.max(axis=(0, 1)), (stacked != -1).sum(axis=1), stacked[stacked != -1]
        if (ids < 0).any():  # characters without a piece
            as_bytes = [list(chr(-3 - x).encode("utf-8", "replace")) if x < 0 else None for x in ids.tolist()]
            length += np.add.reduceat([len(x) - 1 if x else 0 for x in as_bytes], np.cumsum(length) - length)
            ids = np.array([i for x, bs in zip(ids.tolist(), as_bytes, strict=True) for i in ([x] if bs is None else [self.pieces.byte + b for b in bs])])
        return best, second, length, ids.astype(np.int32)

    def _edges(self, unit: str, end: int):
        for k in range(1, min(self.longest, end) + 1):
            i = self.id_of.get(unit[end - k : end])
            if i is not None:
                yield k, float(self.score[i]), i
            elif k == 1:
                yield 1, self.pieces.unknown, None

    def forward(self, unit: str) -> list[float]:
        ahead = [0.0]
        for end in range(1, len(unit) + 1):
            ahead.append(max(ahead[end - k] + s for k, s, _ in self._edges(unit, end)))
        return ahead

    def n_best(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations, best first: A* from the end, the Viterbi scores telling what is left exactly.

        Of equal estimates the one with less left is followed, and no place is left more than n times, as the n best need
        no more: a long run of one character costs its length, not the number of its equal ways.
        """
        ahead, out, tick, left = self.forward(unit), [], 0, {}
        heap = [(-ahead[-1], len(unit), 0, 0.0, None)]
        while heap and len(out) < n:
            _, end, _, done, path = heapq.heappop(heap)
            if not end:
                ids = []
                while path:
                    (i, c), path = path
                    ids += [i] if i is not None else [self.pieces.byte + b for b in c.encode("utf-8", "replace")]
                out.append((done, ids))
                continue
            if left.setdefault(end, 0) >= n:
                continue
            left[end] += 1
            for k, s, i in self._edges(unit, end):
                tick += 1
                heapq.heappush(heap, (-(done + s + ahead[end - k]), end - k, tick, done + s, ((i, unit[end - k : end]), path)))
        return out

    def add(self, units: set[str]) -> None:
        """Searches units not yet known."""
        fresh = sorted(units - self.known.keys(), key=len)
        short = [u for u in fresh if len(u) <= WIDE]
        best, second, lengths, ids, i = [], [], [], [], 0
        while i < len(short):
            few = short[i : i + max(256, 40_000 // len(short[i]))]
            few = [u for u in few if len(u) <= len(few[0]) + 4]
            for held, x in zip((best, second, lengths, ids), self._search(few), strict=True):
                held.append(x)
            i += len(few)
        for u in fresh[len(short) :]:
            found = self.n_best(u, 2)
            for held, x in zip((best, second, lengths, ids), (found[0][0], found[1][0] if len(found) > 1 else -np.inf, len(found[0][1]), found[0][1]), strict=True):
                held.append(np.atleast_1d(x))
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            length = np.concatenate(lengths).astype(np.int64)
            self.start = np.append(self.start, len(self.ids) + np.cumsum(length) - length)
            self.length, self.ids = np.append(self.length, length), np.concatenate([self.ids, *ids]).astype(np.int32)
            self.best, self.second = np.append(self.best, np.concatenate(best)), np.append(self.second, np.concatenate(second))
            self.met = np.append(self.met, np.zeros(len(fresh), np.int64))

    def gaps(self, unit: str, n: int) -> list[tuple[float, np.ndarray, bool]]:
        """What each of a unit's n best segmentations costs beyond the best, its ids, and whether they decode to the same bytes."""
        if unit not in self.nearest:
            found = [(s, np.array(ids, np.int32)) for s, ids in self.n_best(unit, n)]
            self.nearest[unit] = [(found[0][0] - s, ids, self.bytes_of(ids) == self.bytes_of(found[0][1])) for s, ids in found]
        return self.nearest[unit]

    def encode(self, texts: list[str], n: int = N_BEST) -> list[list[tuple[float, np.ndarray, bool]]]:
        """For each text its n best segmentations, best first, as score, ids and whether they decode as the best does; one of score 0 without ids for an empty text.

        Each of the n best is the best but for some of the n - 1 units whose second best costs least.
        """
        if len(self.known) > self.most:
            self._keep_common()
        split = [units_of(t) for t in texts]
        self.add({u for units in split for u in units})
        out = []
        for units in split:
            at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
            self.met[at] += 1  # once a text
            gap = self.best[at] - self.second[at]
            few = np.argpartition(gap, n - 2)[: n - 1] if 0 < n - 1 < len(gap) else np.arange(len(gap))
            few = np.flatnonzero(gap <= gap[few].max(initial=-np.inf))
            few = few[np.argsort(gap[few], kind="stable")][: n - 1]  # the cheapest; equals in the order of the text
            ways: list[tuple[float, tuple]] = [(0.0, ())]
            for k in few.tolist():
                if np.isfinite(gap[k]):
                    ways = heapq.nsmallest(n, [(cost + more, (*changes, (k, j)) if j else changes) for cost, changes in ways for j, (more, *_) in enumerate(self.gaps(units[k], n))])
            total, best = float(self.best[at].sum()), self.ids[runs(self.start[at], self.length[at])]
            place = np.cumsum(self.length[at])
            found = [(total, best, True)]
            for cost, changes in ways[1:]:
                parts, last = [], 0
                for k, j in sorted(changes):
                    parts += [best[last : place[k] - self.length[at[k]]], self.nearest[units[k]][j][1]]
                    last = place[k]
                found.append((total - cost, np.concatenate([*parts, best[last:]]), all(self.nearest[units[k]][j][2] for k, j in changes)))
            out.append(found)
        return out

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_of(ids).replace(SPACE.encode(), b" ")[1:]


def matrix(strings: list[str], width: int) -> np.ndarray:
    """Code points of the strings, a row each, zeros after the end."""
    return np.frombuffer("".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(strings), width)


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{FOLDER}/piece_bpe_32k.model", n: int = N_BEST, with_ids: bool = True) -> DataFrame:
    """The n best segmentations of each row, best first, as arrays: ``scores``, ``n_pieces``, ``n_fallback`` (byte pieces), ``md5`` (of the ids as little-endian 32-bit numbers), ``decoded`` and, if asked for, the ids themselves as ``segmentations``.

    ``decoded`` says whether the ids give back the text; a text that holds the vocabulary's space mark gives back a space for
    it, and false. Null and empty texts have one segmentation of no pieces and score 0. A lattice with fewer paths than n
    gives fewer segmentations. Of equal scores the order is fixed, and the same for equal texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(vocabulary))  # a vocabulary's fixed size

    def make():
        lattice = Lattice(shared.value)
        byte = shared.value.byte

        def each(batch):
            out: dict[str, list] = {k: [] for k in ("scores", "n_pieces", "n_fallback", "md5", "decoded", "segmentations")}
            for i in range(0, batch.num_rows, 500):
                raws = [x or b"" for x in batch["text"].slice(i, 500).to_pylist()]
                for raw, found in zip(raws, lattice.encode([x.decode("utf-8", "replace") for x in raws], n), strict=True):
                    ids, whole = [x for _, x, _ in found], lattice.decode(found[0][1]) == raw
                    out["scores"].append([s for s, _, _ in found])
                    out["n_pieces"].append([len(x) for x in ids])
                    out["n_fallback"].append([int(((x >= byte) & (x < byte + 256)).sum()) for x in ids])
                    out["md5"].append([hashlib.md5(x.astype("<i4", copy=False).data).hexdigest() for x in ids])
                    out["decoded"].append([whole and alike for _, _, alike in found])
                    out["segmentations"].append(ids if with_ids else None)
            return out | {"doc_id": batch["doc_id"]}

        return each

    ids = ", segmentations array<array<int>>" if with_ids else ""
    return map_rows(keyed(docs, id_col, text_col), make, f"doc_id {id_type(docs, id_col)}, scores array<double>, n_pieces array<long>, n_fallback array<long>, md5 array<string>, decoded array<boolean>{ids}")
