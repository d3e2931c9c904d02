"""Small pure-Python models of the clustering rounds, written from their definitions."""

from collections import Counter, defaultdict


def symmetric(edges):
    out = {}
    for u, v, s in edges:
        if u != v:
            out[u, v] = out[v, u] = s
    return out


def best(sim, count, t):
    found = {}
    for (u, v), s in sim.items():
        score = s / (count[u] * count[v])
        if score > t and score > -10000 and (u not in found or (score, -v) > (found[u][0], -found[u][1])):
            found[u] = (score, v)
    return found


def scc(points, edges, thresholds):
    sim, node, count = symmetric(edges), {p: p for p in points}, Counter(points)
    levels = [dict(node)]
    for t in thresholds:
        parent = {n: n for n in count}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, (_, v) in best(sim, count, t).items():
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
        up = {n: find(n) for n in count}
        node = {p: up[n] for p, n in node.items()}
        count = Counter(node.values())
        made = defaultdict(float)
        for (u, v), s in sim.items():
            if up[u] != up[v]:
                made[up[u], up[v]] += s
        sim = dict(made)
        levels.append(dict(node))
    return levels


def dag_round(nodes, sim, count, t, max_parents):
    found = best(sim, count, t)
    mate = {n: found[n][1] if n in found else n for n in nodes}
    score = {n: found[n][0] if n in found else 0.0 for n in nodes}
    chosen = {n: min(n, mate[n]) if mate[mate[n]] == n else n for n in nodes}
    cand = defaultdict(list)
    for n in nodes:
        cand[n].append((chosen[n], score[n]))
        if chosen[mate[n]] != chosen[n]:
            cand[mate[n]].append((chosen[n], score[n]))
    kept = {n: [p for p, _ in sorted(cand[n], key=lambda x: (-x[1], x[0]))[:max_parents]] for n in nodes}
    votes = Counter(p for ps in kept.values() for p in ps)
    out = {}
    for n in nodes:
        ps = [p for p in kept[n] if votes[p] == 2]
        if chosen[n] not in ps:
            ps.append(n)
        out[n] = set(ps)
    return out


def dag(edges, rounds, linkage, max_parents=5):
    sim = symmetric(edges)
    nodes = sorted({x for e in edges for x in e[:2]})
    leaf, desc, count, out = dict(sim), {n: {n} for n in nodes}, dict.fromkeys(nodes, 1), []
    for _ in range(rounds):
        if len(nodes) <= 1:
            break
        par = dag_round(nodes, sim, count if linkage == "approx_average" else dict.fromkeys(nodes, 1), float("-inf"), max_parents)
        new_desc, new_count = defaultdict(set), Counter()
        for n, ps in par.items():
            for p in ps:
                new_desc[p] |= desc[n]
                new_count[p] += count[n]
        made = {}
        if linkage == "average":
            for a in new_desc:
                for b in new_desc:
                    if a != b:
                        pairs = [leaf[x, y] for x in new_desc[a] for y in new_desc[b] if (x, y) in leaf]
                        if pairs:
                            made[a, b] = sum(pairs) / (len(new_desc[a]) * len(new_desc[b]))
        else:
            for (u, v), s in sim.items():
                for p in par[u]:
                    for q in par[v]:
                        if p != q:
                            made[p, q] = max(made.get((p, q), s), s) if linkage == "single" else made.get((p, q), 0.0) + s
        out.append(par)
        sim, desc, count, nodes = made, new_desc, new_count, sorted(new_desc)
    return out
