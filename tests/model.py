"""Plain-Python model of the definitions, for small inputs."""

from collections import Counter, defaultdict

FLIP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(FLIP)[::-1]


def canon(s):
    return min(s, rc(s))


def count(seqs, low, high):
    return Counter((k, canon(s[i : i + k])) for s in seqs for k in range(low, high + 1) for i in range(len(s) - k + 1))


def extensions(counts):
    """(k, kmer) -> (forward bases, reverse bases)."""
    out = defaultdict(lambda: (set(), set()))
    for k, y in counts:
        for w in {y, rc(y)}:
            p, c = w[:-1], w[-1]
            n = canon(p)
            if p == n:
                out[k - 1, n][0].add(c)
            if rc(p) == n:
                out[k - 1, n][1].add(c)
    return out


def mask(forward, reverse):
    return sum(128 >> "ACGT".index(c) for c in forward) + sum(8 >> "ACGT".index(c) for c in reverse)


def clean(counts, min_k):
    """Level by level from the longest k-mers, as defined."""
    ext, protected = extensions(counts), set()
    top = max(k for k, _ in counts)
    for k in range(top, min_k, -1):
        for kk, x in sorted(counts):
            if kk != k:
                continue
            parents = [(k - 1, canon(x[1:])), (k - 1, canon(x[:-1]))]
            telling = any(p == rc(p) or max(map(len, ext[j, p])) > 1 for j, p in parents)
            if (k, x) in protected or telling:
                protected.add((k, x))
                protected.update(parents)
    return {n for n in counts if n[0] <= min_k or n in protected}


def seen_after(w, nodes):
    mask = nodes[canon(w)][1]
    return {c for i, c in enumerate("ACGT") if mask >> (7 - i if w == canon(w) else 3 - i) & 1}


def walk(w, nodes, min_k):
    """(length or minus length on a loop, places of nodes in order): longer contexts first, then shorter ones."""
    path, met, length, allowed, last = [w], {w}, len(w), set("ACGT"), False
    while True:
        steps = [w + c for c in sorted(allowed) if canon(w + c) in nodes]
        if steps:
            if steps[0] in met:
                return -length, path
            w, length, last = steps[0], length + 1, False
            met.add(w)
            path.append(w)
            allowed = seen_after(w, nodes)
            continue
        if last or w == rc(w):
            return length, path
        allowed = seen_after(w, nodes) if canon(w) in nodes else set("ACGT")
        w = w[1:]
        last = len(w) < min_k or canon(w) not in nodes
        if not last and w in met:
            return -length, path
        met |= set() if last else {w}
        if not w:
            return length, path


def linked(a, b):
    """Parent and child, or siblings that overlap in all but one base."""
    return any(len(x) == len(y) + 1 and y in (x[1:], x[:-1]) or len(x) == len(y) and x[1:] == y[:-1] for x, y in ((a, b), (b, a), (a, rc(b)), (rc(a), b), (rc(b), a), (b, rc(a))))


def settled(nodes, strength, min_k):
    """Groups of nodes whose two walks agree, or that can't be split further: (nodes, start of the contig)."""
    start = min(nodes, key=lambda x: (-len(x), x))
    n0, path = walk(start, nodes, min_k)
    loop, n1, back = n0 < 0, 0, rc(start)
    if not loop:
        n1, path = walk(rc(path[-1]), nodes, min_k)
        loop = n1 < 0
        if not loop:
            back = path[-1]
            n0, path = walk(rc(back), nodes, min_k)
            loop = n0 < 0
        else:
            back = None
    if (loop or n0 != n1) and strength > 0:
        cut, left, out = (strength / 2 if strength >= 2.32831e-10 else 0.0), set(nodes), []
        while left:
            part, todo, most = set(), [min(left)], 0.0
            while todo:
                x = todo.pop()
                part.add(x)
                left.discard(x)
                for y in nodes:
                    d = abs(nodes[x][0] - nodes[y][0]) / max(nodes[x][0], nodes[y][0], 1)
                    if y != x and d <= cut and linked(x, y):
                        most = max(most, d)
                        todo += [y] if y in left else []
            out += settled({x: nodes[x] for x in part}, most, min_k)
        return out
    return [(nodes, back and rc(back))]
