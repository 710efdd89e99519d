"""Brute-force versions that several tests share."""

import re

from tessella.llm import exact_dedup

EN, DE = "the of and that with were which there every thing shall".split(), "der und nicht eine werden zwischen schon über große straße".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) + str(rng.randrange(50) if rng.random() < 0.2 else "") for _ in range(n))


def _sets(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().translate(exact_dedup.ASCII_LOWER).decode())
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def near(rows, width):
    nodes = [(i, _sets(t, width)) for i, t, *_ in rows]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for k, (a, s) in enumerate(nodes):
        for b, q in nodes[k + 1 :]:
            n = len(s & q)
            if n and 100 * n >= 80 * (len(s) + len(q) - n):
                a_, b_ = find(a), find(b)
                up[max(a_, b_)] = min(a_, b_)
    return {i: (len(s), find(i)) for i, s in nodes}


def budgets(leaves, part, epochs, weights):
    """Water-filling by bisection, node by node. weights: by level and name, or a power of a node's tokens."""
    def tokens(node):
        return sum(map(tokens, node.values())) if isinstance(node, dict) else node

    def weight(level, name, node):
        if not isinstance(weights, dict):
            return tokens(node) ** weights
        return max(0.0, weights[level].get(name, weights[level].get("other", 0.0)))

    def fill(budget, nodes, level):
        caps, ws = [tokens(n) * epochs for n in nodes.values()], [weight(level, k, n) for k, n in nodes.items()]
        lo, hi = 0.0, 1e15
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(c, mid * w) for c, w in zip(caps, ws)) < budget else (lo, mid)
        return [min(c, hi * w) for c, w in zip(caps, ws)]

    out, tree = {}, {}
    for (d, g, s), n in leaves.items():
        tree.setdefault(d, {}).setdefault(g, {})[s] = n
    total = sum(leaves.values())
    for d, b in zip(tree, fill(min(part * total, total * epochs), tree, "domain")):
        for g, bg in zip(tree[d], fill(b, tree[d], "lang")):
            for s, bs in zip(tree[d][g], fill(bg, tree[d][g], "source")):
                out[d, g, s] = bs
    return out
