"""Plain reference computations for small fixtures."""


def components(nodes, links):
    """node -> least node reachable"""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
