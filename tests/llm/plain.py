"""Brute-force versions of the operators' definitions, on plain Python values."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text):
    return WORD.findall(text or "")


def _luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and _luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def personal(text):
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in PII.items()
            for m in re.finditer(pattern, text or "") if _passes(kind, m.group(0))]


def without_repeats(rows, length=20):
    """``(doc_id, text)`` in ascending order -> ``(doc_id, n_words, n_removed, sha of kept)``."""
    seen, out = {}, []
    for doc_id, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[i:i + length]), (doc_id, i)) != (doc_id, i):
                gone[i:i + length] = [True] * length
        out.append((doc_id, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def least_reachable(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, n):
    w = words(re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard_components(rows, n=3, percent=90):
    sets = {i: shingles(t, n) for i, t in rows}
    lists = defaultdict(list)
    edges = []
    for i, s in sets.items():
        shared = defaultdict(int)
        for gram in s:
            for j in lists[gram]:
                shared[j] += 1
            lists[gram].append(i)
        edges += [(i, j) for j, k in shared.items() if 100 * k >= percent * (len(s) + len(sets[j]) - k)]
    component = least_reachable(sets, edges)
    return {i: (len(sets[i]), component[i]) for i in sets}


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text)


def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text or ""))


def license_finds(text, templates):
    """``(label, first, last, share, phrase)`` of each phrase and block, as a set."""
    w, out = license_words(text), set()
    for t in templates:
        asked, n = t.words, len(t.words)
        if t.phrase:
            out |= {(t.label, i, i + n, 1.0, True) for i in range(len(w) - n + 1) if w[i:i + n] == asked}
            continue
        for low in range(0, len(w), n):
            share = len(set(w[low:low + 2 * n]) & set(asked)) / len(set(asked))
            if share >= t.share - 1e-9:
                out.add((t.label, low, min(low + 2 * n, len(w)), share, False))
    return out


def merkle(rows):
    """``(doc_id, source, lang, n_chars, text)`` -> ``(doc_id, leaf, subroot, root, proof sha, folded, verified)``."""
    def told(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(row):
        return sha("".join(map(told, row)))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i:i + 8])) for i in range(0, len(last), 8)])
        return levels

    def way(levels, i):
        for nodes in levels[:-1]:
            run = i // 8 * 8
            yield nodes[run:i], nodes[i + 1:run + 8]
            i //= 8

    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda x: x[:3])
    levels = {lang: climb([x[2] for x in trees[lang]]) for lang in langs}
    forest = climb([levels[lang][-1][0] for lang in langs])
    out = []
    for n, lang in enumerate(langs):
        for i, (_, _, own, row) in enumerate(trees[lang]):
            steps = [*way(levels[lang], i), *way(forest, n)]
            folded = own
            if zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 3 == 0:
                folded = leaf((*row[:4], None if row[4] is None else lowered(row[4])))
            for before, after in steps:
                folded = sha("".join([*before, folded, *after]))
            root = forest[-1][0]
            out.append((row[0], own, levels[lang][-1][0], root, sha("".join(x for b, a in steps for x in [*b, *a])),
                        folded, folded == root))
    return out


def alignment(rows, encode_a, encode_b, bytes_a, bytes_b):
    """``(doc_id, text)`` -> ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``."""
    docs, counts = [], defaultdict(int)
    for doc_id, text in rows:
        groups = []
        if text:
            whole = (" " + text).encode()
            a, b = encode_a(" " + text), encode_b(text)
            if b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == whole:
                i = j = 0
                while i < len(a):
                    x, y = [a[i]], [b[j]]
                    i, j = i + 1, j + 1
                    while (p := sum(len(bytes_a(t)) for t in x)) != (q := sum(len(bytes_b(t)) for t in y)):
                        if p < q:
                            x.append(a[i])
                            i += 1
                        else:
                            y.append(b[j])
                            j += 1
                    groups.append((x, y))
        links = [(p, q) for x, y in groups for p in x for q in y]
        for pair in set(links):
            counts[pair] += 1
        docs.append((doc_id, groups, links))
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    return [(doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
             sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links),
             ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups))
            for doc_id, groups, links in docs]
