"""Orders of a graph given as node -> upstream nodes."""

from __future__ import annotations

from collections.abc import Mapping, Set


def layers(edges: Mapping[str, Set[str]]) -> list[list[str]]:
    """Levels of nodes whose upstreams are all in earlier levels, sorted by name; unknown upstreams are ignored."""
    waiting = {n: {u for u in ups if u in edges} for n, ups in edges.items()}
    out: list[list[str]] = []
    while waiting:
        ready = sorted(n for n, ups in waiting.items() if not ups)
        if not ready:
            raise ValueError(f"cycle among {sorted(waiting)}")
        out.append(ready)
        done = set(ready)
        waiting = {n: ups - done for n, ups in waiting.items() if n not in done}
    return out


def topological(edges: Mapping[str, Set[str]]) -> list[str]:
    """Upstreams first; first come first served, by name where several become free at once."""
    degree = {n: sum(u in edges for u in ups) for n, ups in edges.items()}
    users: dict[str, list[str]] = {n: [] for n in edges}
    for n in sorted(edges):
        for u in edges[n]:
            if u in edges:
                users[u].append(n)
    queue = sorted(n for n, d in degree.items() if not d)
    for n in queue:  # grows while it is read
        for user in users[n]:
            degree[user] -= 1
            if not degree[user]:
                queue.append(user)
    if len(queue) < len(edges):
        raise ValueError(f"cycle among {sorted(set(edges) - set(queue))}")
    return queue
