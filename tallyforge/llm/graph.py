"""A robust-pruned directed graph over the vectors of one shard, and beam search on it (numpy, many searches at a time)."""

from __future__ import annotations

import numpy as np

#: Out-degree; beam while building; relaxation of the pruning; nodes expanded at a time; spare places for joining strays.
DEGREE, BUILD_BEAM, ALPHA, EXPAND, SPARE = 32, 96, 1.2, 4, 8
_CELLS = 1 << 24


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x over a power of two each, its exponents): the largest component of each lies between 0.5 and 1."""
    e = np.frexp(np.abs(x).max(axis=1, initial=0))[1]
    return np.ldexp(x, -e[:, None]), e


def lifted(x: np.ndarray) -> np.ndarray:
    """x, over a power of two, with one more coordinate that makes all norms equal: nearest by distance is then largest by
    inner product."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(initial=0))[1])  # squares of any finite numbers stay finite, also as float32
    n = np.einsum("ij,ij->i", x, x)
    return np.concatenate([x, np.sqrt(np.maximum(n.max(initial=0) - n, 0))[:, None]], axis=1).astype(np.float32)


def search(x: np.ndarray, norms: np.ndarray, links: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search from entry for each row of q: (ids, squared distances less |q|^2), nearest first; id -1 fills up."""
    n, m = len(q), len(x)
    beam = min(beam, m)
    step = max(1, min(512, _CELLS // max(1, m)))
    ids, dist = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf, np.float32)
    for lo in range(0, n, step):
        a, b = _search(x, norms, links, entry, q[lo : lo + step], beam)
        ids[lo : lo + step], dist[lo : lo + step] = a, b
    return ids, dist


def _search(x, norms, links, entry, q, beam):
    n, m = len(q), len(x)
    ids, dist, open_ = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf, np.float32), np.zeros((n, beam), bool)
    ids[:, 0], dist[:, 0], open_[:, 0] = entry, norms[entry] - 2 * (q @ x[entry]), True
    seen = np.zeros((n, m + 1), bool)  # a column more for the filler -1
    seen[:, -1] = True
    seen[:, entry] = True
    live = np.arange(n)
    while len(live):
        d = np.where(open_[live], dist[live], np.inf)
        width = min(EXPAND, beam)
        at = np.argpartition(d, width - 1, axis=1)[:, :width] if width < beam else np.tile(np.arange(beam), (len(live), 1))
        picked = np.take_along_axis(ids[live], at, 1)
        picked = np.where(np.isfinite(np.take_along_axis(d, at, 1)), picked, -1)
        open_[live[:, None], at] = False
        near = np.where((picked >= 0)[:, :, None], links[picked], -1).reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1  # two expanded nodes may share a neighbour
        near[seen[live[:, None], near]] = -1
        kept = (near >= 0).sum(axis=1).max(initial=0)
        if kept:
            near = -np.sort(-near, axis=1)[:, :kept]
            seen[live[:, None], near] = True
            nd = norms[near] - 2 * np.einsum("ijk,ik->ij", x[near], q[live], optimize=True)
            nd[near < 0] = np.inf
            all_ids, all_d = np.concatenate([ids[live], near], 1), np.concatenate([dist[live], nd], 1)
            all_open = np.concatenate([open_[live], near >= 0], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids[live], dist[live], open_[live] = (np.take_along_axis(c, best, 1) for c in (all_ids, all_d, all_open))
        live = live[(open_[live] & np.isfinite(dist[live])).any(axis=1)]
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def prune(x: np.ndarray, norms: np.ndarray, node: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node its nearest candidates, without those that a kept one is nearer to by the factor alpha."""
    out = np.full((len(node), degree), -1, np.int64)
    step = max(1, _CELLS // (cand.shape[1] * (cand.shape[1] + x.shape[1])))
    for lo in range(0, len(node), step):
        p, c = node[lo : lo + step], cand[lo : lo + step]
        xc = x[c]
        d = norms[c] + norms[p][:, None] - 2 * np.einsum("ijk,ik->ij", xc, x[p], optimize=True)
        d[(c < 0) | (c == p[:, None])] = np.inf
        between = norms[c][:, :, None] + norms[c][:, None, :] - 2 * np.matmul(xc, xc.transpose(0, 2, 1))
        r = np.arange(len(p))
        for k in range(degree):
            best = d.argmin(axis=1)
            ok = np.isfinite(d[r, best])
            if not ok.any():
                break
            out[lo + r[ok], k] = c[r[ok], best[ok]]
            gone = alpha * alpha * np.maximum(between[r, best], 0) <= d
            d[gone & ok[:, None]] = np.inf
            d[r, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(links: a row of out-neighbours for each vector, -1 fills up; entry). x: lifted vectors."""
    m = len(x)
    links = np.full((m, degree + SPARE), -1, np.int64)
    norms = np.einsum("ij,ij->i", x, x)
    entry = int((norms - 2 * (x @ x.mean(axis=0))).argmin()) if m else -1
    order = np.random.default_rng(0).permutation(m)
    order = np.concatenate([[entry], order[order != entry]]) if m else order
    done = 1
    while done < m:  # batches double up to a fiftieth of the shard
        batch = order[done : done + max(1, min(done, max(64, m // 50)))]
        ids, _ = search(x, norms, links, entry, x[batch], beam)
        links[batch, :degree] = prune(x, norms, batch, ids, degree, alpha)
        _back(x, norms, links, batch, degree, alpha)
        done += len(batch)
    _join_strays(x, norms, links, entry, degree, beam)
    return links, entry


def _back(x, norms, links, batch, degree, alpha):
    """The reverse of the batch's links; a node with too many is pruned again."""
    src = np.repeat(batch, degree)
    dst = links[batch, :degree].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    to, first, n = np.unique(dst, return_index=True, return_counts=True)
    had = (links[to, :degree] >= 0).sum(axis=1)
    for few in (True, False):
        pick = (had + n <= degree) == few
        if not pick.any():
            continue
        wide = int((had + n)[pick].max())
        cand = np.full((int(pick.sum()), max(wide, degree)), -1, np.int64)
        cand[:, :degree] = links[to[pick], :degree]
        rows = np.repeat(np.arange(len(cand)), n[pick])
        offset = np.arange(n[pick].sum()) - np.repeat(np.cumsum(n[pick]) - n[pick], n[pick])
        cand[rows, np.repeat(had[pick], n[pick]) + offset] = src[np.repeat(first[pick], n[pick]) + offset]
        if few:
            links[to[pick], :degree] = cand[:, :degree]
            continue
        most = 4 * degree
        if cand.shape[1] > most:  # the nearest are enough to choose from
            for i in range(0, len(cand), 256):
                c = cand[i : i + 256]
                d = norms[c] - 2 * np.einsum("ijk,ik->ij", x[c], x[to[pick][i : i + 256]], optimize=True)
                d[c < 0] = np.inf
                cand[i : i + 256, :most] = np.take_along_axis(c, np.argsort(d, axis=1)[:, :most], 1)
            cand = cand[:, :most]
        links[to[pick], :degree] = prune(x, norms, to[pick], cand, degree, alpha)


def _join_strays(x, norms, links, entry, degree, beam):
    """Gives every node that the entry doesn't reach a link from a near node that it does reach."""
    m = len(x)
    while m:
        reached, front = np.zeros(m, bool), np.array([entry])
        reached[entry] = True
        while len(front):
            nxt = np.unique(links[front])
            front = nxt[(nxt >= 0) & ~reached[nxt]]
            reached[front] = True
        stray = np.flatnonzero(~reached)
        if not len(stray):
            return
        ids, _ = search(x, norms, links, entry, x[stray], beam)
        joined = False
        for s, near in zip(stray, ids, strict=True):
            for v in near[near >= 0]:
                free = np.flatnonzero(links[v] < 0)
                if len(free):
                    links[v, free[0]] = s
                    joined = True
                    break
        if not joined:  # no room nearby: take it from any node that has some
            room = np.flatnonzero(reached & (links < 0).any(axis=1))
            links[room[0], np.flatnonzero(links[room[0]] < 0)[0]] = stray[0]
