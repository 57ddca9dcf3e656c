"""Min-cost flow on small graphs by successive shortest paths."""

from __future__ import annotations

from collections import deque


def min_cost_flow(edges: list[tuple], source, sink) -> list[int]:
    """The flow on each edge (from, to, capacity, cost) of a maximal flow that costs least. Costs are not negative."""
    out: dict = {}
    to, room, cost = [], [], []
    for a, b, capacity, price in edges:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out.setdefault(x, []).append(len(to))
            out.setdefault(y, [])
            to.append(y)
            room.append(c)
            cost.append(p)
    while source in out and sink in out:
        far, via, queue, queued = {source: 0}, {}, deque([source]), {source}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in out[x]:
                d = far[x] + cost[e]
                if room[e] and d < far.get(to[e], float("inf")):
                    far[to[e]], via[to[e]] = d, e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if sink not in far:
            break
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return [room[2 * i + 1] for i in range(len(edges))]
