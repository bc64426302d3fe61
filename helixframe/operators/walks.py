"""Walks along a group of nodes, in plain Python for grouped functions.

A group is a dict from canonical k-mer to (coverage, edges); an oriented string is a place and a direction.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

FLIP = str.maketrans("ACGT", "TGCA")
TINY = 2.32831e-10


def rc(s: str) -> str:
    return s.translate(FLIP)[::-1]


def key(w: str) -> str:
    return min(w, rc(w))


def observed(w: str, nodes: dict) -> set[str]:
    """Bases seen after w; all four for a place outside the group."""
    n = nodes.get(key(w))
    if n is None:
        return set("ACGT")
    bits = n[1] >> 4 if w == key(w) else n[1]
    return {c for i, c in enumerate("ACGT") if bits & (8 >> i)}


def first_base(candidates: list[str], context: str) -> str:
    """The choice unless another is given: bases in their order."""
    return candidates[0]


class Walk:
    """One walk over a group, place by place (H5).

    A place is an oriented string and may be met once: meeting one again ends the walk as a loop.  From a
    place that is a node of the group the walk either *extends*, by a base that gives a longer node, or
    *shortens* its context by the oldest base, after which only bases seen behind the longer context will
    do.  A context that is no node, or shorter than min_k, may be tried once more; a place that is its own
    reverse complement can't be shortened.  choose(candidates, context) picks among possible bases (X5).
    """

    def __init__(self, start: str, nodes: dict, min_k: int, take: Callable[[str, int], None] | None = None, choose: Callable[[list[str], str], str] = first_base):
        self.nodes, self.min_k, self.take, self.choose = nodes, min_k, take, choose
        self.place = self.end = start
        self.length, self.met = len(start), {start}
        self.bases, self.last_chance = set("ACGT"), False

    def extend(self) -> bool | None:
        """True after a step, False if no base leads on, None if the step closes a loop."""
        options = [c for c in "ACGT" if c in self.bases and key(self.place + c) in self.nodes]
        if not options:
            return False
        base = options[0] if len(options) == 1 else self.choose(options, self.place)
        longer = self.place + base
        if longer in self.met:
            return None
        self.met.add(longer)
        self.place = self.end = longer
        self.length += 1
        self.bases, self.last_chance = observed(longer, self.nodes), False
        if self.take:
            self.take(base, self.nodes[key(longer)][0])
        return True

    def shorten(self) -> bool | None:
        """True after dropping a base, False where the walk ends, None if the shorter place was met before."""
        if self.last_chance or self.place == rc(self.place):
            return False
        self.bases = observed(self.place, self.nodes)
        self.place = self.place[1:]
        self.last_chance = len(self.place) < self.min_k or key(self.place) not in self.nodes
        if not self.last_chance:
            if self.place in self.met:
                return None
            self.met.add(self.place)
        return len(self.place) > 0

    def run(self) -> tuple[int, str]:
        """(length, last node); the length is negative where the walk meets itself."""
        step: bool | None = True
        while step:
            step = self.extend()
            if step is False:
                step = self.shorten()
        return (-self.length if step is None else self.length), self.end


def walk(start: str, nodes: dict, min_k: int, take: Callable[[str, int], None] | None = None, choose: Callable[[list[str], str], str] = first_base) -> tuple[int, str]:
    return Walk(start, nodes, min_k, take, choose).run()


def link_strength(a: int, b: int) -> float:
    return abs(a - b) / max(a, b, 1)


def near(kmer: str, nodes: dict) -> set[str]:
    """Children, parents and siblings of a node that are in the group."""
    out = set()
    for w in (kmer, rc(kmer)):
        out.update(key(w + c) for c in "ACGT")
        out.update(key(w[1:] + c) for c in "ACGT")
        out.add(key(w[1:]))
    out.discard(kmer)
    return {x for x in out if x in nodes}


def parts_within(nodes: dict, cutoff: float) -> list[tuple[dict, float]]:
    """Components over links of strength up to cutoff, each with its strongest such link."""
    left, out = set(nodes), []
    for first in sorted(nodes, key=lambda x: (len(x), x)):
        if first not in left:
            continue
        left.discard(first)
        todo, part, most = [first], {first: nodes[first]}, 0.0
        while todo:
            x = todo.pop()
            for y in near(x, nodes):
                ls = link_strength(nodes[x][0], nodes[y][0])
                if ls <= cutoff:
                    most = max(most, ls)
                    if y in left:
                        left.discard(y)
                        part[y] = nodes[y]
                        todo.append(y)
        out.append((part, most))
    return out


def settle(nodes: dict, strength: float, min_k: int) -> list[dict]:
    """H3: the group, or what it has to be split into, as dicts of nodes, endpoints, contig_length, strength, cyclic."""
    todo, out = [(nodes, strength)], []
    while todo:
        group, ls = todo.pop()
        start = min(group, key=lambda x: (-len(x), x))
        looped = False
        n0, far = walk(start, group, min_k)
        if n0 >= 0:
            n1, back = walk(rc(far), group, min_k)
            if n1 >= 0:
                n0, far = walk(rc(back), group, min_k)
                looped = n0 < 0
            else:
                looped = True
        else:
            looped, n1, back = True, 0, rc(start)
        if (looped or n0 != n1) and ls > 0:
            todo += parts_within(group, 0.0 if ls < TINY else ls / 2)
            continue
        out.append({"nodes": group, "ends": (rc(back), rc(far)), "length": abs(n0), "strength": ls, "cyclic": looped})
    return out


def contig(start: str, nodes: dict, min_k: int) -> tuple[str, float]:
    """(sequence, average coverage) of the walk from start."""
    taken: list[tuple[str, int]] = []
    walk(start, nodes, min_k, lambda c, cov: taken.append((c, cov)))
    first = nodes.get(key(start), (0, 0))[0]
    seq = start + "".join(c for c, _ in taken)
    return seq, (first * len(start) + sum(v for _, v in taken)) / len(seq)


def joined(a: dict, b: dict, nodes: dict, min_k: int) -> tuple[int, tuple[str, str]] | None:
    """H7: the longest walk over both groups from any of their ends, if longer than either contig."""
    best = None
    for start in (*a["ends"], *b["ends"]):
        n, far = walk(start, nodes, min_k)
        if n > max(a["length"], b["length"]) and (best is None or n > best[0]):
            best = n, (start, rc(far))
    return best


def merge_all(groups: dict[str, dict], min_k: int, max_rounds: int) -> dict[str, dict]:
    """H9: groups (name -> nodes, ends, length, strength) after merging, pairing by pairing in ascending order of
    (link strength, names), in rounds until none merges."""
    for _ in range(max_rounds):
        of = {x: g for g, v in groups.items() for x in v["nodes"]}
        every = {x: c for v in groups.values() for x, c in v["nodes"].items()}
        weakest: dict[tuple[str, str], float] = {}
        for x in every:
            for y in near(x, every):
                if of[x] < of[y]:
                    pair, ls = (of[x], of[y]), link_strength(every[x][0], every[y][0])
                    weakest[pair] = min(ls, weakest.get(pair, ls))
        moved: dict[str, str] = {}

        def now(g: str, moved=moved) -> str:
            while g in moved:
                g = moved[g]
            return g

        tested: set[tuple[str, str]] = set()
        todo = sorted((ls, *pair) for pair, ls in weakest.items())
        heapq.heapify(todo)
        while todo:
            ls, a, b = heapq.heappop(todo)
            x, y = sorted((now(a), now(b)))
            if x == y or (x, y) in tested:
                continue
            if (x, y) != (a, b):
                heapq.heappush(todo, (ls, x, y))  # under its present names, so that ties fall as they do anywhere
                continue
            tested.add((x, y))
            nodes = groups[x]["nodes"] | groups[y]["nodes"]
            best = joined(groups[x], groups[y], nodes, min_k)
            if best is None:
                continue
            other = groups.pop(y)
            groups[x] = {"nodes": nodes, "ends": best[1], "length": best[0], "strength": max(groups[x]["strength"], other["strength"], ls), "cyclic": groups[x]["cyclic"] or other["cyclic"], "has_palindrome": groups[x]["has_palindrome"] or other["has_palindrome"]}
            moved[y] = x
            tested = {p for p in tested if x not in p and y not in p}
        if not moved:
            break
    return groups


def greedy(seed: str, coverage: dict[str, int], min_k: int) -> tuple[str, list[int]]:
    """Extend seed to both sides by the base whose node scores highest, coverage * k * (k - 1).

    Each base is judged at the longest context that has it.  Nodes are used once, so walks end.  A base's
    coverage is the highest of its own node and of those that later bases within the node's k take.
    """
    used = {key(seed)}

    def ahead(w: str) -> tuple[str, list[int]]:
        at, grown, covs = w, [], []
        while True:
            best = None
            for c in "ACGT":
                for k in range(len(at), min_k - 1, -1):
                    child = key(at[-k:] + c)
                    if child in coverage:
                        score = coverage[child] * (k + 1) * k
                        if child not in used and (best is None or score > best[0]):
                            best = score, c, child
                        break
            if best is None:
                return "".join(grown), covs
            at = (at + best[1])[1:]
            grown.append(best[1])
            here = coverage[best[2]]
            back = max(0, len(covs) - len(best[2]))
            covs[back:] = [max(v, here) for v in covs[back:]]
            covs.append(here)
            used.add(best[2])

    forward, after = ahead(seed)
    backward, before = ahead(rc(seed))
    own = [coverage.get(key(seed), 0)] * len(seed)
    return rc(backward) + seed + forward, before[::-1] + own + after
