"""Plain single-machine definitions that small results are compared with."""

import numpy as np

FLOOR = 1e-9


def composite(v, h, weight, scale):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    d = 1 - u @ u.T
    if weight:
        d = (1 - weight) * d + weight * np.minimum(np.abs(h[:, None] - h[None, :]) / scale, 1)
    d = np.maximum(d, 0)
    for i in range(len(v)):  # copies are exactly zero apart
        same = (v == v[i]).all(axis=1) & (h == h[i] if weight else True)
        d[i, same] = d[same, i] = 0
    return d


def components(nodes, d, below):
    nodes, out = set(nodes), []
    while nodes:
        todo, comp = [nodes.pop()], set()
        while todo:
            x = todo.pop()
            comp.add(x)
            near = {y for y in nodes if d[x, y] < below}
            nodes -= near
            todo += near
        out.append(frozenset(comp))
    return out


def longest_link(nodes, d):
    """Longest edge of a minimum spanning tree: the level at which the set first falls apart."""
    nodes = sorted(nodes)
    best = {x: d[nodes[0], x] for x in nodes[1:]}
    longest = 0.0
    while best:
        x = min(best, key=best.get)
        longest = max(longest, best.pop(x))
        for y in best:
            best[y] = min(best[y], d[x, y])
    return longest


def hdbscan_labels(v, h, min_samples=3, epsilon=0.0, weight=0.55, scale=12.0, min_size=2):
    """Top-down: lower the level through all mutual-reachability values, splitting components."""
    d = composite(np.asarray(v, float), np.asarray(h, float), weight, scale)
    core = np.sort(d, axis=1)[:, min_samples - 1]
    m = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    np.fill_diagonal(m, 0)
    tree = {}

    def grow(members, birth, parent):
        key = members
        node = {"birth": birth, "parent": parent, "kids": [], "stab": 0.0, "leave": {}}
        tree[key] = node
        cur = members
        while True:
            w = longest_link(cur, m)
            comps = components(cur, m, w)
            if len(comps) < 2:  # all at one zero level
                for p in cur:
                    node["leave"][p] = FLOOR
                node["form"] = 0.0
                break
            big = [c for c in comps if len(c) >= min_size]
            if len(big) == 1:
                for c in comps:
                    if len(c) < min_size:
                        for p in c:
                            node["leave"][p] = max(w, FLOOR)
                cur = big[0]
                continue
            for p in cur:
                node["leave"][p] = max(w, FLOOR)
            node["form"] = w
            for c in big:
                node["kids"].append(c)
                grow(c, w, key)
            break
        if birth is not None:
            node["stab"] = sum(1 / x for x in node["leave"].values()) - len(members) / max(birth, FLOOR)

    root = frozenset(range(len(d)))
    grow(root, None, None)
    chosen, value = {}, {}
    for key in sorted(tree, key=len):
        kids = tree[key]["kids"]
        below = sum(value[k] for k in kids)
        s = tree[key]["stab"]
        if key == root:
            chosen[key] = False
        else:
            chosen[key] = not kids or s >= below
        value[key] = max(s, below)

    def top_down(key, open_):
        take = open_ and chosen[key]
        out = [key] if take else []
        for k in tree[key]["kids"]:
            out += top_down(k, open_ and not take)
        return out

    picked = top_down(root, True)
    if epsilon > 0:
        final = set()
        for c in picked:
            while tree[c]["birth"] <= epsilon and tree[c]["parent"] != root:
                c = tree[c]["parent"]
            final.add(c)
        picked = [c for c in final if not any(c < o for o in final)]
    labels = [-1] * len(d)
    for c in picked:
        for p in c:
            labels[p] = min(c)
    return labels


def partition(labels):
    groups, noise = {}, set()
    for i, x in enumerate(labels):
        if x == -1:
            noise.add(i)
        else:
            groups.setdefault(x, set()).add(i)
    return {frozenset(g) for g in groups.values()}, noise
