"""A hierarchical navigable small-world graph in flat numpy arrays, built and searched for many vectors at once.

Nodes are numbered by falling level, so layer l holds the nodes 0 .. counts[l] - 1 and its links are one array of
counts[l] rows and a fixed width, -1 where a node has fewer neighbours. Vectors are inserted in batches that are no larger than
the graph so far: a batch descends from the top, finds its neighbours among the nodes before it and in the batch itself,
keeps those that no kept one is nearer to, and is linked back from them.
"""

from __future__ import annotations

import numpy as np

#: Nodes opened at once for each query.
OPEN = 4
#: Nodes kept on the way down through the upper layers.
WAY = 8
_NONE = np.float32(-np.inf)


def batch_size(dim: int) -> int:
    """Vectors worked on at once: fewer of long ones."""
    return int(np.clip(16384 // max(dim, 1), 16, 256))


def search(links: np.ndarray, x: np.ndarray, q: np.ndarray, starts: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), nearest first, of the `ef` nearest nodes that a best-first walk from `starts` finds for each query."""
    rows = np.arange(len(q))
    seen = np.zeros((len(q), len(links) + 1), bool)
    ids, sim = np.full((len(q), ef), -1, np.int32), np.full((len(q), ef), _NONE)
    fresh = np.zeros((len(q), ef), bool)
    active, next_ids = rows, starts
    while len(active):
        seen[active[:, None], next_ids] = True
        met = np.einsum("rwd,rd->rw", x[next_ids], q[active])
        met[next_ids < 0] = _NONE
        all_sim = np.concatenate([sim[active], met], axis=1)
        keep = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
        sim[active] = np.take_along_axis(all_sim, keep, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], next_ids], axis=1), keep, 1)
        fresh[active] = np.take_along_axis(np.concatenate([fresh[active], next_ids >= 0], axis=1), keep, 1)
        waiting = np.where(fresh, sim, _NONE)
        active = rows[waiting.max(1) > _NONE]
        if not len(active):
            break
        best = np.argpartition(-waiting[active], min(OPEN, ef) - 1, axis=1)[:, : min(OPEN, ef)]
        opened = np.take_along_axis(waiting[active], best, 1) > _NONE
        fresh[active[:, None], best] = False
        around = links[np.take_along_axis(ids[active], best, 1)]
        around[~opened] = -1
        next_ids = np.sort(around.reshape(len(active), -1), axis=1)
        next_ids[:, 1:][next_ids[:, 1:] == next_ids[:, :-1]] = -1
        next_ids[seen[active[:, None], next_ids]] = -1
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


def select(x: np.ndarray, ids: np.ndarray, sim: np.ndarray, width: int) -> np.ndarray:
    """`width` neighbours out of the candidates: nearest first, those nearer to a chosen one only where room is left."""
    order = np.argsort(-sim, axis=1, kind="stable")
    ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
    between = x[ids] @ x[ids].transpose(0, 2, 1)
    chosen = np.zeros(ids.shape, bool)
    number = np.zeros(len(ids), np.int64)
    for k in range(ids.shape[1]):
        near = np.where(chosen[:, :k], between[:, k, :k], _NONE).max(1, initial=_NONE)
        chosen[:, k] = (sim[:, k] > near) & (number < width)
        number += chosen[:, k]
    first = np.argsort(~chosen, axis=1, kind="stable")[:, :width]
    found = np.take_along_axis(ids, first, 1)
    found[np.take_along_axis(sim, first, 1) == _NONE] = -1
    return found


def _link_back(links: np.ndarray, x: np.ndarray, batch: np.ndarray, found: np.ndarray, step: int) -> None:
    """Add the links from the found neighbours back to the batch; full nodes choose again."""
    source, target = np.repeat(batch, found.shape[1]), found.ravel()
    source, target = source[target >= 0], target[target >= 0]
    near = np.einsum("nd,nd->n", x[source], x[target])
    order = np.lexsort((-near, target))
    source, target = source[order], target[order]
    nodes, begin, number = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(begin, number)
    width = links.shape[1]
    new = np.full((len(nodes), min(int(number.max(initial=0)), width)), -1, np.int32)
    kept = rank < width
    new[np.repeat(np.arange(len(nodes)), number)[kept], rank[kept]] = source[kept]
    for at in range(0, len(nodes), step):
        own, old, more = nodes[at : at + step], links[nodes[at : at + step]], new[at : at + step]
        more[(more[:, :, None] == old[:, None, :]).any(2)] = -1  # two of a batch may have chosen each other
        ids = np.concatenate([old, more], axis=1)
        sim = np.einsum("nwd,nd->nw", x[ids], x[own])
        sim[ids < 0] = _NONE
        links[own] = select(x, ids, sim, width)


def build(x: np.ndarray, level: np.ndarray, m: int, ef: int) -> list[np.ndarray]:
    """The links of each layer over unit vectors `x` (float32), whose levels fall: m neighbours, 2 * m in layer 0."""
    top = int(level[0]) if len(level) else 0
    counts = [int((level >= at).sum()) for at in range(top + 1)]
    links = [np.full((n, m if at else 2 * m), -1, np.int32) for at, n in enumerate(counts)]
    done, step = 1, batch_size(x.shape[1])
    while done < len(x):
        # All of a batch have one level.
        size = min(done, step, counts[level[done]] - done)
        batch = np.arange(done, done + size, dtype=np.int32)
        q = x[batch]
        mates = q @ q.T
        np.fill_diagonal(mates, _NONE)
        close = np.argpartition(-mates, min(2 * m, size) - 1, axis=1)[:, : 2 * m]
        close_sim = np.take_along_axis(mates, close, 1)
        mate_ids = np.where(close_sim > _NONE, batch[close], -1).astype(np.int32)
        starts = np.zeros((size, 1), np.int32)
        for at in range(top, -1, -1):
            if at > level[done]:
                starts, _ = search(links[at], x, q, starts, WAY)
                continue
            starts, sim = search(links[at], x, q, starts, ef)
            found = select(x, np.concatenate([starts, mate_ids], axis=1), np.concatenate([sim, close_sim], axis=1), m)
            links[at][batch, : found.shape[1]] = found
            _link_back(links[at], x, batch, found, 2 * step)
        done += size
    return links


def nearest(links: list[np.ndarray], x: np.ndarray, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of the `ef` nearest nodes found for each of few queries, nearest first; -1 where there are fewer."""
    starts = np.zeros((len(q), 1), np.int32)
    for at in range(len(links) - 1, 0, -1):
        starts, _ = search(links[at], x, q, starts, WAY)
    return search(links[0], x, q, starts, ef)
