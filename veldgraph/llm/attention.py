"""A causal self-attention language model on subword ids, in numpy.

One layer and head with learned biases for the distance between positions, on
top of the embedding of the last subword. The softmax has two levels: a group of
subwords that occur alike, then a class within the group; a frequent subword is
a class of its own, the others have their share of the corpus counts in theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Positions of a context window, and how many of them (the last) are scored.
CONTEXT, STRIDE = 32, 24
WIDTH = 16
#: Groups of the softmax, classes of a group, and how many of these are no single subwords.
GROUPS, CLASSES, SHARED = 48, 32, 8
#: Slots that a subword's neighbours are hashed to, and how far away the last of them are.
SLOTS, REACH = 96, 10
#: Windows that are worked on at once, in training and in scoring.
BATCH = 96
SCORED_BATCH = 96
#: Windows whose positions are put in order of their groups together.
SLAB = 2048
#: Rows that the trainer multiplies at once where it adds up over all rows.
STRETCH = 256
#: Weights of which the trainer makes a step together.
PIECE = 1 << 15
LOG10 = np.log(10.0)


@dataclass
class Windows:
    """Index of windows over sequences laid end to end; each position is scored once."""

    positions: np.ndarray  # windows x CONTEXT, clipped
    valid: np.ndarray  # windows x CONTEXT: the position lies within the sequence
    scored: np.ndarray  # windows x STRIDE


def windows(lengths: np.ndarray) -> Windows:
    first = np.cumsum(lengths) - lengths
    count = -(-lengths // STRIDE)
    row = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    inside = (nth * STRIDE - (CONTEXT - STRIDE))[:, None] + np.arange(CONTEXT)
    valid = (inside >= 0) & (inside < lengths[row][:, None])
    return Windows(np.clip(inside, 0, (lengths[row] - 1)[:, None]) + first[row][:, None], valid, valid[:, CONTEXT - STRIDE :])


_ALLOWED = np.arange(CONTEXT)[None, :] <= (np.arange(STRIDE) + CONTEXT - STRIDE)[:, None]
_DISTANCE = np.clip((np.arange(STRIDE) + CONTEXT - STRIDE)[:, None] - np.arange(CONTEXT)[None, :], 0, CONTEXT - 1)


def surroundings(ids: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The subwords in sequences that lie end to end, and for each how often each slot stands before, after and around (2 to REACH away) it."""
    some = np.flatnonzero(np.bincount(ids, minlength=size))
    local = np.zeros(size, np.int64)
    local[some] = np.arange(len(some))
    # REACH places that are no subword follow each sequence: a row and a column more, left out of the result
    n, width = len(some), SLOTS + 1
    places = np.arange(len(ids)) + np.repeat(np.arange(len(lengths)) * REACH, lengths)
    row, slot = (np.full(len(ids) + len(lengths) * REACH, x, np.int64) for x in (n * width, SLOTS))
    row[places], slot[places] = local[ids] * width, (ids.astype(np.int64) * 2654435761 >> 7) % SLOTS
    flat = np.zeros((3, (n + 1) * width), np.int64)
    for d in range(1, REACH + 1):
        for part, x in ((0, row[d:] + slot[:-d]), (1, row[:-d] + slot[d:])):
            flat[part if d == 1 else 2] += np.bincount(x, minlength=flat.shape[1])
    return some, flat.reshape(3, n + 1, width)[:, :n, :SLOTS].transpose(1, 0, 2)


def contexts(around: np.ndarray) -> np.ndarray:
    """What stands before, after and around each subword, as a unit vector of hashed shares."""
    shares = np.sqrt(around / np.maximum(around.sum(axis=2, keepdims=True), 1))
    return shares.reshape(len(around), -1).astype(np.float32)


def _clustered(x: np.ndarray, weight: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means of unit vectors by their direction."""
    centre = x[rng.choice(len(x), n, replace=False, p=weight / weight.sum())]
    for _ in range(rounds):
        near = np.argmax(x @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x * weight[:, None])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
    return near


def grouped(counts: np.ndarray, some: np.ndarray, around: np.ndarray, seed: int = 9) -> np.ndarray:
    """The group of each subword by what stands around it: ``around`` that of ``some`` (see ``surroundings``); the others form a group more."""
    group = np.full(len(counts), GROUPS, np.int64)
    if len(some):
        group[some] = _clustered(contexts(around), np.sqrt(np.maximum(counts[some], 1)), min(GROUPS, len(some)), np.random.default_rng(seed))
    return group


def classes_of(counts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class in its group of each subword, and the log share of a subword in its class (counts smoothed by a half).

    In a group the most frequent subwords are classes of their own, the rest go
    by falling count into SHARED more.
    """
    smooth = counts + 0.5
    order = np.lexsort((np.arange(len(counts)), -counts, group))
    rank = np.arange(len(counts)) - np.searchsorted(group[order], group[order])
    single = CLASSES - SHARED
    size = np.bincount(group, minlength=GROUPS + 1)[group[order]]
    of = np.empty(len(counts), np.int64)
    of[order] = np.where(rank < single, rank, single + (rank - single) * SHARED // np.maximum(1, size - single))
    mass = np.bincount(group * CLASSES + of, weights=smooth, minlength=(GROUPS + 1) * CLASSES)
    return of.astype(np.int32), np.log(smooth / mass[group * CLASSES + of]).astype(np.float32)


class Model:
    """``row``: each subword's row of the tables; subwords that no training document has share row 0, whose vector is zero."""

    def __init__(self, counts: np.ndarray, sample: np.ndarray, seed: int = 3, group: np.ndarray | None = None):
        """``group`` of each subword; without it they are grouped by what stands around them in ``sample``."""
        rng = np.random.default_rng(seed)
        if group is None:
            group = grouped(np.bincount(sample, minlength=len(counts)), *surroundings(sample, np.array([len(sample)]), len(counts)))
        self.group = group.astype(np.int32)
        self.of, self.share = classes_of(counts, group)
        # frequent subwords first: their rows lie close together
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((np.arange(len(counts)), -counts))] = np.arange(len(counts))
        self.row = np.where(counts > 0, rank + 1, 0).astype(np.int32)
        n, k = int(self.row.max(initial=0)) + 1, GROUPS + 1
        draw = lambda *shape, by=0.1: (rng.standard_normal(shape) * by).astype(np.float32)
        mass = np.bincount(self.group * CLASSES + self.of, weights=counts + 0.5, minlength=k * CLASSES).reshape(k, CLASSES)
        self.p = {
            "embed": draw(n, WIDTH, by=0.3),
            "query": draw(WIDTH, WIDTH, by=0.25),
            "key": draw(WIDTH, WIDTH, by=0.25),
            "value": draw(WIDTH, WIDTH, by=0.25),
            "near": np.linspace(1.0, -1.0, CONTEXT, dtype=np.float32),
            "out": draw(2 * WIDTH, k),
            # a group or class without subwords is out of reach
            "bias": np.where(mass.sum(axis=1) > 0, np.log(np.maximum(mass.sum(axis=1), 1e-9) / mass.sum()), -1e9).astype(np.float32),
            "within": draw(k, 2 * WIDTH, CLASSES),
            "within_bias": np.where(mass > 0, np.log(np.maximum(mass, 1e-9) / np.maximum(mass.sum(axis=1, keepdims=True), 1e-9)), -1e9).astype(np.float32),
        }
        self.p["embed"][0] = 0
        self.tables()

    def tables(self) -> None:
        """Queries, keys and values depend on the subword alone: look them up."""
        p = self.p
        q, k, v = (p["embed"] @ p["query"]) / np.float32(np.sqrt(WIDTH)), p["embed"] @ p["key"], p["embed"] @ p["value"]
        # as they are fetched: keys with values (and a one, which adds up the weights), queries with embeddings
        self.kv = np.concatenate((k, v, np.ones((len(v), 1), np.float32)), axis=1)
        self.qe = np.concatenate((q, p["embed"]), axis=1)
        self.mask = np.where(_ALLOWED, p["near"][_DISTANCE], np.float32(-1e9)).astype(np.float32)

    def weights(self, ids: np.ndarray) -> np.ndarray:
        """All weights end to end, each row of ``embed`` times the number of its occurrences in ``ids``, and these numbers: sums of such arrays make a mean."""
        seen = np.bincount(self.row[ids], minlength=len(self.p["embed"])).astype(np.float32)
        return np.concatenate([seen, (self.p["embed"] * seen[:, None]).ravel(), *(x.ravel() for k, x in self.p.items() if k != "embed"), np.ones(1, np.float32)])

    def take_mean(self, total: np.ndarray) -> None:
        """Set the weights to the mean of the arrays (see ``weights``) that were summed; rows that none has seen stay."""
        n, (rows, width) = float(total[-1]), self.p["embed"].shape
        seen, embed = total[:rows], total[rows : rows + rows * width].reshape(rows, width)
        some = seen > 0
        self.p["embed"][some] = embed[some] / seen[some, None]
        at = rows + rows * width
        for k, x in self.p.items():
            if k != "embed":
                self.p[k] = (total[at : at + x.size] / np.float32(n)).reshape(x.shape)
                at += x.size
        self.tables()

    def compact(self) -> Model:
        """Without the look-up tables, for sending."""
        for name in ("kv", "qe", "mask"):
            self.__dict__.pop(name, None)
        return self

    def ready(self) -> Model:
        if not hasattr(self, "kv"):
            self.tables()
        return self

    def log_probabilities(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For sequences end to end (each begins with the start symbol): the natural log probability of each next subword.

        The last position of a sequence has no next subword and gets 0.
        """
        result = np.zeros(len(ids), np.float32)
        w = windows(lengths)
        following = np.append(ids[1:], ids[:1])
        rows, group, share = self.row[ids], self.group[following].astype(np.uint8), self.share[following]  # a byte sorts faster
        of, late = self.of[following], CONTEXT - STRIDE
        joined = self._joined()
        out, within = joined["out"], joined["within"]
        h = np.empty((min(SLAB, len(w.positions)) * STRIDE, 2 * WIDTH + 1), np.float32)
        for first in range(0, len(w.positions), SLAB):
            last = min(first + SLAB, len(w.positions))
            here = w.positions[first:last, late:].ravel()
            goal = group.take(here)
            log_p = share.take(here)
            for i in range(first, last, SCORED_BATCH):
                j = min(i + SCORED_BATCH, last)
                part = slice((i - first) * STRIDE, (j - first) * STRIDE)
                self._mix(rows.take(w.positions[i:j]), w.valid[i:j], h[part])
                log_p[part] += _log_shares(h[part] @ out, goal[part])
            # of the classes within their groups, one group after the other
            order = np.argsort(goal, kind="stable")
            stop = np.cumsum(np.bincount(goal, minlength=GROUPS + 1))
            classes = of.take(here)
            for g, (i, j) in enumerate(zip([0, *stop[:-1].tolist()], stop.tolist())):
                if i < j:
                    mine = order[i:j]
                    log_p[mine] += _log_shares(h.take(mine, axis=0) @ within[g], classes.take(mine))
            keep = w.scored[first:last].ravel()
            result[here[keep]] = log_p[keep]
        result[np.cumsum(lengths) - 1] = 0
        return result

    def _mix(self, own: np.ndarray, valid: np.ndarray, h: np.ndarray) -> None:
        """Fill ``h`` with what the softmax of some windows' next subwords works on: last embedding, mixed values, a one."""
        late = CONTEXT - STRIDE
        qe, kv = self.qe.take(own[:, late:], axis=0), self.kv.take(own, axis=0)
        a = qe[..., :WIDTH] @ kv[..., :WIDTH].transpose(0, 2, 1)
        a += self.mask
        if len(early := np.flatnonzero(~valid[:, 0])):  # keys before the sequence; those after it are masked anyway
            a[early] += np.where(valid[early], np.float32(0), np.float32(-1e9))[:, None, :]
        a = _exponentials(a.reshape(-1, CONTEXT))[0].reshape(a.shape)
        mixed = (a @ kv[..., WIDTH:]).reshape(-1, WIDTH + 1)
        h[:, :WIDTH] = qe[..., WIDTH:].reshape(-1, WIDTH)
        np.divide(mixed, mixed[:, WIDTH:], out=h[:, WIDTH:])

    def train(self, ids: np.ndarray, lengths: np.ndarray, epochs: int = 1, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam over shuffled batches of windows; gives the mean loss of each epoch."""
        w = windows(lengths)
        late, beyond = CONTEXT - STRIDE, GROUPS + 1
        # rows that do not occur have no gradient and stay: only the others take part (and row 0)
        rows = self.row[ids]
        occurs = np.bincount(rows, minlength=len(self.p["embed"])) > 0
        occurs[0] = True
        rows = (np.cumsum(occurs) - 1)[rows]
        # by window: the subwords' rows, and the next subwords' classes and groups; positions that are not learnt get a group beyond all
        rows = rows.astype(np.uint16 if occurs.sum() <= 1 << 16 else np.int32).take(w.positions)  # few bytes sort faster
        following = np.append(ids[1:], ids[:1])
        group = self.group[following].astype(np.uint8)
        group[np.cumsum(lengths) - 1] = beyond
        here = w.positions[:, late:]
        group, of = np.where(w.scored, group.take(here), np.uint8(beyond)), self.of[following].astype(np.uint8).take(here)
        rng = np.random.default_rng(seed)
        # weights, gradients and moments lie end to end: a step is a few passes over them
        joined = self._joined()
        joined["embed"] = joined["embed"][occurs]
        flat = np.concatenate([x.ravel() for x in joined.values()])
        grad, m, u = (np.zeros_like(flat) for _ in range(3))
        spare = np.empty(PIECE, np.float32)
        p, g = _views(flat, joined), _views(grad, joined)
        embed, near, out, within = (p[name] for name in ("embed", "near", "out", "within"))
        of_group = list(zip(within, within.transpose(0, 2, 1), g["within"]))
        step, losses = 0, []
        steps = epochs * -(-len(w.positions) // BATCH)
        scale = np.float32(1 / np.sqrt(WIDTH))
        # room that the steps share
        keys = np.ones((BATCH * CONTEXT, 3 * WIDTH + 1), np.float32)  # query, key, value of each position, and a one
        dkeys = np.zeros((BATCH, CONTEXT, 3 * WIDTH), np.float32)  # queries before the scored ones stay zero
        h = np.empty((BATCH * STRIDE, 2 * WIDTH + 1), np.float32)  # last embedding, mixed values, a one (for the biases)
        y, far, dh = (np.empty((BATCH * STRIDE, n), np.float32) for n in (CLASSES, 2 * WIDTH + 1, 2 * WIDTH + 1))
        of_mixed = np.repeat(np.array([0, -1, 0], np.float32), [WIDTH, WIDTH, 1])
        for _ in range(epochs):
            order = rng.permutation(len(w.positions))
            loss = seen = 0.0
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                n_windows, n_late = len(pick), len(pick) * STRIDE
                own, valid = rows.take(pick, axis=0).ravel(), w.valid.take(pick, axis=0)
                x = embed.take(own, axis=0)
                qkv = p["qkv"].copy()
                qkv[:, :WIDTH] *= scale
                np.matmul(x, qkv, out=keys[: len(x), : 3 * WIDTH])
                kept = keys[: len(x)].reshape(n_windows, CONTEXT, 3 * WIDTH + 1)
                q, k, v = kept[:, late:, :WIDTH], kept[:, :, WIDTH : 2 * WIDTH], kept[:, :, 2 * WIDTH :]
                a = q @ k.transpose(0, 2, 1)
                a += np.where(_ALLOWED, near[_DISTANCE], np.float32(-1e9))
                if len(early := np.flatnonzero(~valid[:, 0])):  # keys before the sequence; those after it are masked anyway
                    a[early] += np.where(valid[early], np.float32(0), np.float32(-1e9))[:, None, :]
                a, total = _exponentials(a.reshape(-1, CONTEXT))
                a *= (1 / total)[:, None]
                a = a.reshape(n_windows, STRIDE, CONTEXT)
                late_h = h[:n_late]
                by_window = late_h.reshape(n_windows, STRIDE, -1)
                by_window[..., :WIDTH] = x.reshape(n_windows, CONTEXT, WIDTH)[:, late:]
                np.matmul(a, v, out=by_window[..., WIDTH:])
                # positions that are learnt, in order of the groups of their next subwords
                goal = group.take(pick, axis=0).ravel()
                size = np.bincount(goal, minlength=beyond + 1)[:beyond]
                stop = np.cumsum(size)
                live = np.argsort(goal, kind="stable")[: stop[-1]]
                goal, each = goal[live], np.arange(len(live))
                n = np.float32(max(1, len(live)))
                hs = late_h.take(live, axis=0)
                z, total = _exponentials(hs @ out)
                its = each * beyond + goal
                loss -= float(np.log(np.maximum(z.ravel().take(its) / total, 1e-30)).sum())
                z *= (1 / (total * n))[:, None]
                z.ravel()[its] -= 1 / n
                _outer(hs, z, g["out"])
                back = z @ out.T
                parts = [(c, slice(j - k, j)) for c, (j, k) in enumerate(zip(stop.tolist(), size.tolist())) if k]
                for c, part in parts:
                    np.dot(hs[part], of_group[c][0], out=y[part])
                z, total = _exponentials(y[: len(live)])
                its = each * CLASSES + of.take(pick, axis=0).ravel().take(live)
                loss -= float(np.log(np.maximum(z.ravel().take(its) / total, 1e-30)).sum())
                np.multiply(z, (1 / (total * n))[:, None], out=y[: len(live)])
                y.ravel()[its] -= 1 / n
                g["within"][size == 0] = 0
                for c, part in parts:
                    _, turned, g_within = of_group[c]
                    np.dot(hs[part].T, zs := y[part], out=g_within)
                    np.dot(zs, turned, out=far[part])
                back += far[: len(live)]
                seen += len(live)
                # in the place of the one: less what the weights' normalisation takes off the gradients of all energies
                back[:, -1] = (back * hs) @ of_mixed
                late_dh = dh[:n_late]
                late_dh[:] = 0
                late_dh[live] = back
                late_dh = late_dh.reshape(n_windows, STRIDE, -1)
                da = late_dh[..., WIDTH:] @ v.transpose(0, 2, 1)
                da *= a
                g["near"][:] = np.bincount(_DISTANCE[_ALLOWED], weights=da.sum(axis=0)[_ALLOWED], minlength=CONTEXT)
                dqkv = dkeys[:n_windows]
                np.matmul(da, k, out=dqkv[:, late:, :WIDTH])
                np.matmul(da.transpose(0, 2, 1), q, out=dqkv[..., WIDTH : 2 * WIDTH])
                np.matmul(a.transpose(0, 2, 1), late_dh[..., WIDTH:-1], out=dqkv[..., 2 * WIDTH :])
                dqkv = dqkv.reshape(-1, 3 * WIDTH)
                _outer(x, dqkv, g["qkv"])
                g["qkv"][:, :WIDTH] *= scale
                dx = dqkv @ qkv.T
                dx.reshape(n_windows, CONTEXT, WIDTH)[:, late:] += late_dh[..., :WIDTH]
                by_row = np.argsort(own, kind="stable")
                ranked = own.take(by_row)
                fresh = np.append(0, np.flatnonzero(ranked[1:] != ranked[:-1]) + 1)
                g["embed"][:] = 0
                g["embed"][ranked[fresh]] = np.add.reduceat(dx.take(by_row, axis=0), fresh)
                g["embed"][0] = 0
                step += 1
                root = 0.1 / np.sqrt(1 - 0.99**step)
                _descend(flat, grad, m, u, spare, np.float32(1e-8 / root), np.float32(0.1 * rate * (1 - step / (steps + 1)) / (1 - 0.9**step) / root))
            losses.append(loss / max(1.0, seen))
        whole = self.p["embed"].copy()
        whole[occurs] = embed
        self._split(p | {"embed": whole})
        self.tables()
        return losses

    def _joined(self) -> dict[str, np.ndarray]:
        """The weights as training uses them: queries, keys and values side by side; the biases as a last row, for a last column of ones."""
        p = self.p
        return {
            "embed": p["embed"],
            "qkv": np.concatenate([p[name] for name in ("query", "key", "value")], axis=1),
            "near": p["near"],
            "out": np.concatenate((p["out"], p["bias"][None])),
            "within": np.concatenate((p["within"], p["within_bias"][:, None]), axis=1),
        }

    def _split(self, joined: dict[str, np.ndarray]) -> None:
        """Set the weights from what ``_joined`` gave."""
        query, key, value = np.split(joined["qkv"], 3, axis=1)
        out, within = joined["out"], joined["within"]
        new = {"embed": joined["embed"], "query": query, "key": key, "value": value, "near": joined["near"], "out": out[:-1], "bias": out[-1], "within": within[:, :-1], "within_bias": within[:, -1]}
        self.p = {k: new[k].copy() for k in self.p}


def _descend(flat: np.ndarray, grad: np.ndarray, m: np.ndarray, u: np.ndarray, spare: np.ndarray, least: np.float32, rate: np.float32) -> None:
    """A step of Adam, a piece that stays in the cache at a time: ``m`` is ten times the mean of the gradients, ``u`` a hundred times that of their squares."""
    for i in range(0, len(flat), len(spare)):
        g, own_m, own_u = (x[i : i + len(spare)] for x in (grad, m, u))
        by = spare[: len(g)]
        own_m *= np.float32(0.9)
        own_m += g
        g *= g
        own_u *= np.float32(0.99)
        own_u += g
        np.sqrt(own_u, out=by)
        by += least
        np.divide(own_m, by, out=by)
        by *= rate
        flat[i : i + len(spare)] -= by


def _outer(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    """The transpose of ``a`` times ``b``, in stretches of rows that stay in the cache."""
    whole = len(a) // STRETCH * STRETCH
    np.dot(a[whole:].T, b[whole:], out=out)
    if whole:
        out += np.matmul(a[:whole].reshape(-1, STRETCH, a.shape[1]).transpose(0, 2, 1), b[:whole].reshape(-1, STRETCH, b.shape[1])).sum(axis=0)


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Arrays of the shapes of ``like`` that lie end to end in ``flat``."""
    stops = np.cumsum([x.size for x in like.values()])
    return {k: flat[j - x.size : j].reshape(x.shape) for (k, x), j in zip(like.items(), stops)}


def _exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, and their sums. The row's maximum is taken off (in place) only where exponentials could leave the range."""
    ones = np.ones(z.shape[1], np.float32)
    if z.size and z.max() < 60:
        e = np.exp(z)
        total = e @ ones
        if total.min() > 1e-20:
            return e, total
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ ones


def _log_shares(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log share of each row's target in the softmax of the row; maxima as in ``_exponentials``."""
    got, ones = z.ravel().take(np.arange(0, z.size, z.shape[1]) + target), np.ones(z.shape[1], np.float32)
    if z.size and z.max() < 60:
        total = np.exp(z) @ ones
        if total.min() > 1e-20:
            return got - np.log(total)
    top = z.max(axis=1)
    return got - top - np.log(np.exp(z - top[:, None]) @ ones)
