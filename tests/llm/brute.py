"""Plain versions that the operators are held against."""

import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def base_counts(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def dropped_lines(rows, k=2, least=20):
    """{doc_id: line numbers} of lines that an earlier one equals or is within k edits of."""
    places = [(i is None, i or 0, n, line) for i, t in rows if t is not None for n, line in enumerate(t.split("\n")) if len(line) >= least]
    first = {}
    for late, i, n, line in sorted(places):
        first.setdefault(line, (late, i, n))
    limit = dict(first)
    lines = list(first)
    for a in range(len(lines)):
        for b in range(a):
            x, y = lines[a], lines[b]
            if abs(len(x) - len(y)) <= k and distance(x, y) <= k:
                limit[x], limit[y] = min(limit[x], first[y]), min(limit[y], first[x])
    out = defaultdict(set)
    for late, i, n, line in places:
        if (late, i, n) > limit[line]:
            out[None if late else i].add(n)
    return {i: sorted(v) for i, v in out.items()}


def shingles(text, k):
    words = SPACE.findall((text or "").translate(ASCII_LOWER))
    m = min(k, len(words))
    return frozenset(tuple(words[i : i + m]) for i in range(len(words) - m + 1)) if words else frozenset()


def components(rows, k, num):
    """{place: (set size, smallest id of the component)} of rows (id, text) without null ids."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for p, (i, _) in enumerate(rows):
        r = find(p)
        least[r] = min(least.get(r, i), i)
    return [(i, len(sets[p]), least[find(p)]) for p, (i, _) in enumerate(rows)]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def hits(rows, items):
    """[(id, words, hit words, item ids)]."""
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        m = min(8, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[j : j + m])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w = bench_words(t)
        hit, found = set(), set()
        for m in sizes:
            for j in range(len(w) - m + 1):
                own = windows.get(tuple(w[j : j + m]))
                if own:
                    hit.update(range(j, j + m))
                    found |= own
        out.append((i, len(w), len(hit), sorted(map(str, found))))
    return out
