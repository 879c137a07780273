"""Minimum-cost flow for small quota tables, on the driver; no Spark here."""

from __future__ import annotations

import heapq
from collections.abc import Hashable


class Flow:
    """Successive shortest paths with potentials. Arcs must cost nothing or more."""

    def __init__(self) -> None:
        self.at: dict[Hashable, int] = {}
        self.out: list[list[int]] = []
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []

    def node(self, name: Hashable) -> int:
        if name not in self.at:
            self.at[name] = len(self.out)
            self.out.append([])
        return self.at[name]

    def arc(self, a: Hashable, b: Hashable, room: int, cost: float) -> int:
        """Returns the arc's number; ``room[number + 1]`` is what flows through it in the end."""
        i, j, e = self.node(a), self.node(b), len(self.to)
        for x, y, r, c in ((i, j, room, cost), (j, i, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return e

    def send(self, a: Hashable, b: Hashable, amount: int) -> int:
        s, t, sent = self.node(a), self.node(b), 0
        height = [0.0] * len(self.out)
        while sent < amount:
            dist, via, done = {s: 0.0}, {}, set()
            heap = [(0.0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if x in done:
                    continue
                done.add(x)
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] > 0 and y not in done:
                        n = d + max(0.0, self.cost[e] + height[x] - height[y])
                        if n < dist.get(y, float("inf")) - 1e-12:
                            dist[y], via[y] = n, e
                            heapq.heappush(heap, (n, y))
            if t not in done:
                break
            far = dist[t]
            for x in range(len(self.out)):
                height[x] += min(dist.get(x, far), far)
            path, x = [], t
            while x != s:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            step = min(amount - sent, *(self.room[e] for e in path))
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step
            sent += step
        return sent


def balanced_quotas(available: dict[tuple, tuple[int, int]], size: int, steps: int = 8) -> dict[tuple, int]:
    """How many to take from each combination (a, b): available[(a, b)] = (fresh, repeats).

    Every a and every b has an equal target; what a category takes beyond it costs more and more, in ``steps`` rising
    steps of a quarter of the target, then at the highest price without limit; so does, at lower prices, what a
    combination gives beyond an even share. Repeats (records like one that is fresh) cost more than any imbalance. The sum is ``size``, or all there is.
    """
    firsts, seconds = sorted({a for a, _ in available}), sorted({b for _, b in available})
    net = Flow()
    taken: dict[tuple, list[int]] = {}

    def side(names: list, arc) -> None:
        target = max(1, -(-size // max(1, len(names))))
        piece = max(1, target // 4)
        for name in names:
            arc(name, target, 0.0)
            for k in range(1, steps + 1):
                arc(name, piece, float(k))
            arc(name, size, float(steps + 4))

    side(firsts, lambda a, room, cost: net.arc("source", ("a", a), room, cost))
    side(seconds, lambda b, room, cost: net.arc(("b", b), "sink", room, cost))
    even = max(1, -(-size // max(1, len(available))))
    for (a, b), (fresh, repeats) in sorted(available.items()):
        arcs, cost = [], 0.0
        while fresh > 0:  # cheaper than any imbalance of a category, so it only breaks ties between combinations
            piece = min(fresh, even) if cost < 0.01 * steps else fresh
            arcs.append(net.arc(("a", a), ("b", b), piece, cost))
            fresh, cost = fresh - piece, cost + 0.01
        arcs.append(net.arc(("a", a), ("b", b), repeats, 1000.0))
        taken[(a, b)] = arcs
    net.send("source", "sink", size)
    return {k: sum(net.room[e + 1] for e in arcs) for k, arcs in taken.items()}
