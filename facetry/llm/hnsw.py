"""Embedding near-dedup: a navigable small-world graph per shard of a cell, every vector searched in the cells that its links may lie in, links verified."""

from __future__ import annotations

import pickle
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.components import connected_components, local_labels
from facetry.llm.texts import checkpointed

COSINE = 0.9
#: Links of a new node and twice as many for any node; nodes that a batch inserts at once; nodes expanded in a step of a search.
DEGREE, INSERT, STEP = 16, 1024, 4
#: First and last width of a beam; a search that still needs more scans its shard.
BEAM, WIDEST = 32, 512
#: Searches of each sort that an audit repeats by brute force, and the recall that it asks for: of vectors made at the limit, and of the links of vectors searched.
AUDIT, RECALL, LINKED = 512, 0.995, 0.99
#: Vectors of a shard at most (on average); vectors that one task searches.
SHARD, PART = 50_000, 10_000
#: Vectors of one length from which they are dealt to cells; cells at least then and at most; a cell of more than SHARD vectors has several shards.
DEALT, CELLS, MOST_CELLS = 1024, 6, 2048
#: Vectors and bytes of the sample that cells are fitted on, rounds of that, and the share of vectors at the limit whose cell must be searched.
SAMPLE, SAMPLE_BYTES, ROUNDS, ROUTED = 16_384, 32 << 20, 5, 0.998


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def at_limit(x: np.ndarray, toward: np.ndarray) -> np.ndarray:
    """For each of ``x`` a vector at a cosine of COSINE to it, in the direction of ``toward``."""
    off = toward - np.einsum("nd,nd->n", toward, x)[:, None] * x
    length = np.linalg.norm(off, axis=1, keepdims=True)
    return COSINE * x + np.sqrt(1 - COSINE**2) * off / np.where(length > 0, length, 1)


def probes(x: np.ndarray, n: int, random: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two sorts of ``n`` pairs at the limit: some of ``x`` with vectors beside them in any direction, and in the direction of others of ``x``."""
    some, others = x[random.integers(len(x), size=n)], x[random.integers(len(x), size=n)]
    return [(some, at_limit(some, toward)) for toward in (random.normal(size=some.shape), others)]


class Graph:
    """Layers of links over vectors sorted by falling level: layer l has the first ``sizes[l]`` of them."""

    def __init__(self, vectors: np.ndarray, seed: int = 3):
        n = len(vectors)
        level = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(DEGREE)), 6).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.exact = vectors[self.order]
        self.x = self.exact.astype(np.float32)
        top = level.max() if n else 0
        self.sizes = [int((level >= k).sum()) for k in range(top + 1)]
        self.links = [np.full((s, 2 * DEGREE), -1, np.int32) for s in self.sizes]
        self.beam = BEAM
        for layer in range(top, -1, -1):
            self._fill(layer)

    def _fill(self, layer: int) -> None:
        size, done = self.sizes[layer], 0
        while done < size:
            n = min(INSERT, size - done, max(128, done))
            new = np.arange(done, done + n)
            inner = self.x[new] @ self.x[new].T
            inner[np.triu_indices(n)] = -2.0  # only earlier ones of the batch
            k = min(DEGREE, n)
            near = np.argpartition(-inner, k - 1, axis=1)[:, :k]
            ids, sims = np.where(np.take_along_axis(inner, near, 1) > -2, new[near], -1), np.take_along_axis(inner, near, 1)
            if done:
                found, score = self.search(self.x[new], self._entries(self.x[new], layer, done), layer, 2 * BEAM, done)
                ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([sims, score], axis=1)
            chosen = self._choose(ids, sims, DEGREE)
            self.links[layer][new, :DEGREE] = chosen
            self._link_back(layer, np.repeat(new, DEGREE), chosen.ravel())
            done += n

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates those that are nearer to the row than to any chosen before, then the nearest others."""
        order = np.argsort(-np.where(ids < 0, -3, sims), axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        x = self.x[np.maximum(ids, 0)]
        between = x @ x.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            rival = np.where(taken, between[:, k], -2).max(axis=1)
            taken[:, k] = (ids[:, k] >= 0) & (sims[:, k] > rival) & (taken.sum(axis=1) < most)
        rank = np.argsort(np.where(ids < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(ids, rank, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _link_back(self, layer: int, source: np.ndarray, target: np.ndarray) -> None:
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):  # the first node of a layer
            return
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        for at in range(0, len(first), 2048):
            starts = first[at : at + 2048]
            ends = np.append(first, len(target))[at + 1 : at + 1 + len(starts)]
            width = int((ends - starts).max())
            slot = starts[:, None] + np.arange(width)
            more = np.where(slot < ends[:, None], source[np.minimum(slot, len(source) - 1)], -1)
            nodes = target[starts]
            ids = np.concatenate([self.links[layer][nodes], more], axis=1)
            full = (ids >= 0).sum(axis=1) > 2 * DEGREE
            room = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), 1)[:, : 2 * DEGREE]
            if full.any():
                sims = np.einsum("nd,nkd->nk", self.x[nodes[full]], self.x[np.maximum(ids[full], 0)])
                room[full] = self._choose(ids[full], sims, 2 * DEGREE)
            self.links[layer][nodes] = room

    def _entries(self, queries: np.ndarray, layer: int, limit: int | None = None) -> np.ndarray:
        entry = np.zeros((len(queries), 1), np.int64)
        for above in range(len(self.sizes) - 1, layer, -1):
            entry = self.search(queries, entry, above, 4)[0][:, :1]
        return entry if limit is None else np.where(entry < limit, entry, 0)

    def search(self, queries: np.ndarray, entry: np.ndarray, layer: int, beam: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: the nearest nodes found, best first (-1: none), and their cosines."""
        n, q = limit or self.sizes[layer], len(queries)
        beam = min(beam, n)
        seen = np.zeros((q, n + 1), bool)
        seen[:, n] = True  # stands for no node
        rows = np.arange(q)[:, None]
        ids = np.full((q, beam), n)
        sims = np.full((q, beam), -2.0, np.float32)
        ids[:, :1], sims[:, :1] = entry, np.einsum("qd,qd->q", queries, self.x[entry[:, 0]])[:, None]
        seen[rows, entry] = True
        open_ = ids < n
        active = np.arange(q)
        while len(active):
            # the best nodes not yet expanded
            a_open = open_[active]
            pick = np.argsort(~a_open, axis=1, kind="stable")[:, :STEP]
            ok = np.take_along_axis(a_open, pick, 1)
            nodes = np.take_along_axis(ids[active], pick, 1)
            open_[active[:, None], pick] = False
            near = np.where((ok & (nodes < n))[:, :, None], self.links[layer][np.minimum(nodes, n - 1)], -1).reshape(len(active), -1)
            near = np.where((near < 0) | (near >= n), n, near)
            near = np.where(seen[active[:, None], near], n, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            seen[active[:, None], near] = True
            width = int((near < n).sum(axis=1).max())
            if width:
                near = np.sort(near, axis=1)[:, :width]
                score = np.einsum("qd,qkd->qk", queries[active], self.x[np.minimum(near, n - 1)])
                score[near == n] = -2.0
                all_ids, all_sims = np.concatenate([ids[active], near], axis=1), np.concatenate([sims[active], score], axis=1)
                all_open = np.concatenate([open_[active], near < n], axis=1)
                order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                ids[active], sims[active], open_[active] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_sims, all_open))
            active = active[open_[active].any(axis=1)]
        return np.where(ids < n, ids, -1), sims

    def matches(self, exact: np.ndarray, skip: np.ndarray | None = None, probed: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of cosine >= COSINE in double precision; ``skip`` names a node for each query to leave out.

        Beams widen for queries whose whole beam matches, and for all while an audit against brute force falls short; a query
        that needs more than the widest beam scans the shard. ``audited`` is the audit's recall, 1 where all is scanned;
        without ``probed`` it is that of the queries' own links alone, as the graph's beam was found by probes before.
        """
        self.audited = 1.0
        if not len(self.exact) or not len(exact):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.exact) <= 4 * BEAM or self.beam > WIDEST:
            return self._scan(exact, np.arange(len(exact)), skip)
        if recall := self._audit(exact, skip, probed):
            self.audited = recall
            return self._beams(exact, skip)
        return self._scan(exact, np.arange(len(exact)), skip)

    def _audit(self, exact: np.ndarray, skip: np.ndarray | None, probed: bool) -> float:
        """Widens the beam until searches find links as brute force does; the least recall of any sort, or 0 (and a beam beyond the widest) if the widest doesn't do.

        Probes at a cosine of COSINE to vectors of the graph must find their nearest one: they stand for vectors that link,
        so that the audit measures something where no two vectors link. Of vectors searched, those that link must find their
        links, unless they fill the beam, which then widens by itself. Each query counts once.
        """
        sorts = []
        if probed:
            for _, made in probes(self.exact, AUDIT, np.random.default_rng(11)):
                sims = made @ self.exact.T
                sorts.append((made, sims >= sims.max(axis=1, keepdims=True) - 1e-6, 1, RECALL))
        own = np.linspace(0, len(exact) - 1, min(AUDIT, len(exact))).astype(int)
        near = exact[own] @ self.exact.T >= COSINE
        if skip is not None:
            near[np.arange(len(own)), skip[own]] = False
        if (linked := near.any(axis=1)).any():
            sorts.append((exact[own[linked]], near[linked], None, LINKED))
        while True:
            recalls = []
            for queries, truth, most, _ in sorts:
                q = queries.astype(np.float32)
                ids, sims = self.search(q, self._entries(q, 0), 0, self.beam)
                found = ((ids >= 0) & np.take_along_axis(truth, np.maximum(ids, 0), 1)).sum(axis=1)
                full = ((sims >= COSINE - 1e-4) & (ids >= 0)).all(axis=1) & (most is None)
                recalls.append(float(np.where(full, 1, np.minimum(1, found / (most or truth.sum(axis=1)))).mean()))
            if all(r >= least for r, (*_, least) in zip(recalls, sorts, strict=True)):
                return min(recalls, default=1.0)
            if self.beam >= WIDEST:
                self.beam = 2 * WIDEST
                return 0.0
            self.beam *= 2

    def _beams(self, exact: np.ndarray, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        out_q, out_n, todo, beam = [], [], np.arange(len(exact)), self.beam
        queries = exact.astype(np.float32)
        while len(todo) and beam <= WIDEST:
            wide = []
            size = max(64, min(1024, 30_000_000 // (len(self.exact) + 1)))
            for i in range(0, len(todo), size):
                rows = todo[i : i + size]
                ids, sims = self.search(queries[rows], self._entries(queries[rows], 0), 0, beam)
                near = (sims >= COSINE - 1e-4) & (ids >= 0)
                more = near.all(axis=1) & (beam < len(self.exact))
                wide.append(rows[more])
                q, k = np.nonzero(near & ~more[:, None])
                q, node = rows[q], ids[q, k]
                ok = np.einsum("nd,nd->n", exact[q], self.exact[node]) >= COSINE
                if skip is not None:
                    ok &= skip[q] != node
                out_q.append(q[ok])
                out_n.append(node[ok])
            todo, beam = np.concatenate(wide), 2 * beam
        q, n = self._scan(exact, todo, skip)
        return np.concatenate([*out_q, q]), np.concatenate([*out_n, n])

    def _scan(self, exact: np.ndarray, rows: np.ndarray, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Brute force by blocks, for queries ``exact[i]`` that are named ``rows[i]`` or, for all of them, are rows of ``exact``."""
        own = exact if len(rows) == len(exact) else exact[rows]
        own_skip = skip if skip is None or len(skip) == len(own) else skip[rows]
        out_q, out_n = [], []
        for i in range(0, len(rows), 512):
            q, node = np.nonzero(own[i : i + 512] @ self.exact.T >= COSINE)
            q = q + i
            ok = slice(None) if own_skip is None else own_skip[q] != node
            out_q.append(rows[q[ok]])
            out_n.append(node[ok])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(out_q), join(out_n)


def vectors_of(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(flat.to_pylist()), np.float64).reshape(len(flat), -1)


def gaps(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's cell, that of the nearest centre, and how far the vector lies from its border with each other cell."""
    inner = x @ centres.T
    home = inner.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-12))
    return home, (np.take_along_axis(inner, home[:, None], 1) - inner) / apart[home]


def fitted_cells(x: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Centres of cells for ``n`` vectors of which ``x`` are a sample, and the gap up to which a vector is searched in another cell.

    Two vectors at the limit are sqrt(2 - 2 COSINE) apart, so that with that gap no link is missed. Mostly a smaller one does:
    that by which, of probes at the limit, all but a share of 1 - ROUTED lie in a cell that either of the two is searched in.
    """
    random = np.random.default_rng(7)
    centres = x[random.permutation(len(x))[: max(1, min(MOST_CELLS, len(x) // 8, max(CELLS, -(-n // SHARD))))]]
    for _ in range(ROUNDS):
        total = np.zeros_like(centres)
        for i in range(0, len(x), 2048):
            np.add.at(total, (x[i : i + 2048] @ centres.T).argmax(axis=1), x[i : i + 2048])
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, total / np.maximum(length, 1e-9), centres)
    least = []
    for sort in probes(x, 2048, random):
        (home, gap), (other, back) = (gaps(side, centres) for side in sort)
        rows = np.arange(len(home))
        least.append(np.quantile(np.minimum(gap[rows, other], back[rows, home]), ROUTED, method="higher"))
    return centres, float(min(max(least), np.sqrt(2 - 2 * COSINE))) + 1e-9


def fit_cells(key, table):
    centres, gap = fitted_cells(unit(vectors_of(table.sort_by("node")["packed"])), table["n"][0].as_py())
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "centres": pa.array([centres.tobytes()], pa.binary()), "gap": pa.array([gap], pa.float64())})


def routed(nodes: DataFrame) -> DataFrame:
    """``cell`` of each vector, and ``others``: the other cells that it is searched in."""
    sizes = nodes.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") >= DEALT)
    most = F.greatest(F.lit(1), F.least(F.lit(SAMPLE), F.floor(F.lit(SAMPLE_BYTES) / (8 * F.col("dim")))))
    sample = nodes.join(F.broadcast(sizes), "dim").where(F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / most)) == 0)
    fits = sample.select("dim", "n", "node", "packed").groupBy("dim").applyInArrow(fit_cells, "dim int, centres binary, gap double")
    cells = nodes.sparkSession.sparkContext.broadcast({r.dim: (np.frombuffer(r.centres).reshape(-1, r.dim), r.gap) for r in fits.toLocalIterator()})  # as large as the cells, whatever the vectors

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                dim, cell, others = b["dim"].to_numpy(), np.zeros(b.num_rows, np.int32), [[]] * b.num_rows
                for d in np.unique(dim):
                    if d in cells.value:
                        rows, (centres, gap) = np.flatnonzero(dim == d), cells.value[d]
                        home, away = gaps(unit(vectors_of(b["packed"].take(pa.array(rows)))), centres)
                        away[np.arange(len(rows)), home] = np.inf
                        cell[rows] = home
                        for row, x in zip(rows, away <= gap, strict=True):
                            others[row] = np.flatnonzero(x).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(b[k] for k in ("node", "times", "packed", "dim")), pa.array(cell), pa.array(others, pa.list_(pa.int32()))], ["node", "times", "packed", "dim", "cell", "others"])

    return nodes.mapInArrow(run, "node long, times long, packed binary, dim int, cell int, others array<int>")


OWN = ("nodes", "times", "n_links", "group", "others")


def shard_graph(key, table):
    """Builds a shard's graph, links its vectors among themselves and returns the graph in pieces."""
    table = table.sort_by("node")
    nodes, times = table["node"].to_numpy(), table["times"].to_numpy()
    graph = Graph(unit(vectors_of(table["packed"])))
    own = {"nodes": nodes[graph.order], "times": times[graph.order], "others": table["others"].take(pa.array(graph.order))}
    q, node = graph.matches(graph.exact, np.arange(len(nodes)))
    label = local_labels(len(nodes), q, node)
    own["n_links"] = np.bincount(q, weights=own["times"][node], minlength=len(nodes)).astype(np.int64)
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, label, own["nodes"])
    own["group"], own["others"] = least[label], np.array([*map(tuple, own["others"].to_pylist()), None], object)[:-1]
    rows = range(0, max(1, len(nodes)), 4096)
    pieces = [pickle.dumps({"exact": graph.exact[i : i + 4096], "links": [x[i : i + 4096] for x in graph.links], "sizes": graph.sizes, "beam": graph.beam, "recall": np.full(len(nodes[i : i + 4096]), graph.audited), **{k: own[k][i : i + 4096] for k in OWN}}, protocol=5) for i in rows]
    names = {k: pa.array([x.as_py()] * len(pieces), pa.int32()) for k, x in zip(("dim", "cell", "sub"), key, strict=True)}
    return pa.table({**names, "piece": pa.array(list(range(len(pieces))), pa.int32()), "graph": pa.array(pieces, pa.binary())})


def graph_of(table) -> tuple[Graph, dict]:
    pieces = [pickle.loads(x) for _, x in sorted(zip(table["piece"].to_pylist(), table["graph"].to_pylist(), strict=True))]
    graph = Graph.__new__(Graph)
    graph.exact = np.concatenate([p["exact"] for p in pieces])
    graph.x, graph.sizes, graph.beam = graph.exact.astype(np.float32), pieces[0]["sizes"], pieces[0]["beam"]
    graph.links = [np.concatenate([p["links"][k] for p in pieces]) for k in range(len(graph.sizes))]
    return graph, {k: np.concatenate([p[k] for p in pieces]) for k in OWN}


FOUND = "node long, n_links long, a long, b long"


def search_shard(key, left, right):
    """Searches a part of the vectors in a shard: links counted for each, and links between groups, each once.

    A vector found counts the link as well, unless it is searched in the other's cell and so finds the link itself.
    """
    kind = pa.schema([(x, pa.int64()) for x in ("node", "n_links", "a", "b")])
    if not left.num_rows or not right.num_rows:
        return kind.empty_table()
    graph, own = graph_of(left)
    q, node = graph.matches(unit(vectors_of(right["packed"])), probed=False)
    n_links = np.bincount(q, weights=own["times"][node], minlength=right.num_rows).astype(np.int64)
    home, cell = right["home"].to_numpy(), key[1].as_py()
    searched = np.repeat(np.arange(len(own["others"])), list(map(len, own["others"]))) * MOST_CELLS + np.fromiter(chain.from_iterable(own["others"]), np.int64)
    back = (home[q] != cell) & ~np.isin(node * MOST_CELLS + home[q], searched)
    n_back = np.bincount(node[back], weights=right["times"].to_numpy()[q[back]], minlength=len(own["nodes"])).astype(np.int64)
    pairs = np.unique(np.stack([right["group"].to_numpy()[q], own["group"][node]], axis=1), axis=0) if len(q) else np.zeros((0, 2), np.int64)
    some, more = n_links > 0, n_back > 0
    names, counts = np.append(right["node"].to_numpy()[some], own["nodes"][more]), np.append(n_links[some], n_back[more])
    blank = [None] * len(names)
    return pa.table({"node": pa.array([*names, *[None] * len(pairs)], pa.int64()), "n_links": pa.array([*counts, *[None] * len(pairs)], pa.int64()), "a": pa.array([*blank, *pairs[:, 0]], pa.int64()), "b": pa.array([*blank, *pairs[:, 1]], pa.int64())})


def packed(vector):
    """The vector's components as bytes, for an Arrow column of one buffer."""

    def run(batches):
        for b in batches:
            flat = b["vector"].flatten().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(pa.compute.list_value_length(b["vector"]).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([b["node"], b["times"], pa.array([flat[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["node", "times", "packed"])

    return vector.mapInArrow(run, "node long, times long, packed binary")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row, by links of cosine 0.9 or more, and the audited ``recall`` of its shard.

    A vector that is null, empty, zero or holds a null or non-finite component has no links and is its own component, as has a
    row with a null identifier (component and ``kept`` null). Equal vectors meet as one node that counts as often as it
    occurs. Vectors of different lengths don't link. Cells are fitted on a bounded sample, and their number follows the number
    of distinct vectors, of which every one is in a cell's graph.
    """
    cast = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), cast.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("vec_id").isNotNull() & F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    ids = checkpointed(rows.select("vec_id", F.when(fit, F.xxhash64("vector")).alias("node"), F.when(fit, F.col("vector")).alias("vector")))
    distinct = ids.where("node is not null").groupBy("node").agg(F.count("*").alias("times"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    distinct = checkpointed(distinct)
    nodes = checkpointed(routed(packed(distinct.select("node", "times", "vector")).withColumn("dim", (F.length("packed") / 8).cast("int"))))
    cells = nodes.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD).alias("subs"))
    nodes = nodes.join(F.broadcast(cells), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int"))
    graphs = checkpointed(nodes.groupBy("dim", "cell", "sub").applyInArrow(shard_graph, "dim int, cell int, sub int, piece int, graph binary"))

    def members(batches):
        for b in batches:
            for x in b["graph"].to_pylist():
                p = pickle.loads(x)
                yield pa.RecordBatch.from_arrays([*(pa.array(p[k], pa.int64()) for k in ("nodes", "n_links", "group")), pa.array(p["recall"], pa.float64())], ["node", "n_links", "group", "recall"])

    own = checkpointed(graphs.select("graph").mapInArrow(members, "node long, n_links long, group long, recall double"))
    targets = nodes.select("dim", F.col("cell").alias("home"), F.col("sub").alias("own_sub"), "node", "times", "packed", F.explode(F.array_append("others", F.col("cell"))).alias("cell"))
    targets = targets.join(F.broadcast(cells), ["dim", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs").cast("int") - 1))).where("cell != home or sub != own_sub")
    parts = targets.groupBy("dim", "cell", "sub").agg(F.ceil(F.count("*") / PART).alias("parts"))
    asked = targets.join(own.select("node", "group"), "node").join(F.broadcast(parts), ["dim", "cell", "sub"]).select("dim", "cell", "sub", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int").alias("part"), "node", "times", "home", "group", "packed")
    shards = graphs.join(F.broadcast(parts), ["dim", "cell", "sub"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).drop("parts")
    shard = ("dim", "cell", "sub", "part")
    found = checkpointed(shards.groupBy(*shard).cogroup(asked.groupBy(*shard)).applyInArrow(search_shard, FOUND))
    groups = connected_components(found.where("a is not null").select("a", "b")).toDF("group", "root")
    counts = own.select("node", "n_links").union(found.where("node is not null").select("node", "n_links")).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    table = distinct.select("node", "times", "least").join(counts, "node").join(own.select("node", "group", "recall"), "node").join(groups, "group", "left").withColumn("root", F.coalesce("root", "group"))
    least = table.groupBy("root").agg(F.min("least").alias("component_id"))
    table = table.join(least, "root").select("node", (F.col("n_links") + F.col("times") - 1).alias("n_links"), "component_id", "recall")
    out = ids.select("vec_id", "node").join(table, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"), "recall")
