"""Plain versions of the operators, for small tables."""

import re

from xxhash import xxh64_intdigest


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def simhash_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(values, linked):
    """The smallest value reachable from each value."""
    values = sorted(set(values))
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if linked(a, b):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}
