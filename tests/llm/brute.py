"""Plain versions of what the operators do, over lists; they share no code with them."""

import re


def words_of(text):
    """(begin, end, word) of the words that count: begin and end with the blanks behind, the first with those before."""
    out, last = [], 0
    for m in re.finditer(r"\S+\s*", text):
        word = "".join(c.lower() if len(c.lower()) == 1 else c for c in m[0].rstrip())
        if any(c.isalnum() for c in word):
            out.append((last, m.end(), word))
        last = m.end()
    return out


def cut(rows, n=10):
    """(doc_id, text, spans) of (doc_id, text) rows: each run of n words that an earlier doc_id has, or this text before
    without overlap, is cut."""
    rank = lambda i: (i is None, i or 0)
    found = [words_of(t or "") for _, t in rows]
    runs = [[tuple(w for *_, w in x[k : k + n]) for k in range(len(x) - n + 1)] for x in found]
    first = {}
    for (i, _), own in zip(rows, runs, strict=True):
        for r in own:
            first[r] = min(first.get(r, rank(i)), rank(i))
    out = []
    for (i, t), words, own in zip(rows, found, runs, strict=True):
        gone, seen = set(), {}
        for k, r in enumerate(own):
            if first[r] < rank(i) or seen.setdefault(r, k) <= k - n:
                gone |= set(range(k, k + n))
        spans = []
        for k in sorted(gone):
            if k - 1 in gone:
                spans[-1] = (spans[-1][0], words[k][1])
            else:
                spans.append((words[k][0], words[k][1]))
        kept, last = [], 0
        for lo, hi in spans:
            kept.append(t[last:lo])
            last = hi
        out.append((i, None if t is None else "".join([*kept, t[last:]]), spans))
    return out


def near_kept(rows):
    """(doc_id, text) of the rows that stay, by all pairs: Jaccard similarity of 0.8 in 5-word shingles, at any remove."""
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            same = a == b if not a or not b else min(len(a), len(b)) >= 0.79 * max(len(a), len(b)) and len(a & b) / len(a | b) >= 0.8
            if same and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [r for k, r in enumerate(rows) if label[k] == k]


def url_templates(rows, children=16, apart=9.0, prior=8.0):
    """(template, purity) of each (host, segments, label) row, label being block, allow or None, by a tree over lists."""
    out = [None] * len(rows)
    counts = lambda at: (sum(rows[i][2] is not None for i in at), sum(rows[i][2] == "block" for i in at))
    labelled, bad = counts(range(len(rows)))

    def walk(at, depth, names, purity):
        below = {}
        for i in at:
            below.setdefault(rows[i][1][depth] if len(rows[i][1]) > depth else "", []).append(i)
        for i in below.pop("", []):
            out[i] = "/".join(names), purity
        many = len(below) + (sum(map(len, below.values())) < len(at)) > children
        kinds = {}
        for s, own in below.items():
            kinds.setdefault("*" if many and len(own) * children < len(at) else s, []).extend(own)
        told = sorted((b / n, s, n, b) for s, own in kinds.items() for n, b in [counts(own)] if n)
        pools = [[s] for s in kinds if s not in {t[1] for t in told}]
        for k, (_, s, n, b) in enumerate(told):
            _, _, n0, b0 = told[k - 1] if k else (0, 0, 0, 0)
            p = (b + b0 + 1) / (n + n0 + 2)
            if k and (b / n - b0 / n0) ** 2 <= apart * p * (1 - p) * (1 / n + 1 / n0):
                pools[-1].append(s)
            else:
                pools.append([s])
        for pool in pools:
            own = [i for s in pool for i in kinds[s]]
            n, b = counts(own)
            name = "{" + "|".join(sorted(pool)) + "}" if len(pool) > 1 else pool[0]
            walk(own, depth + 1, [*names, name], (b + prior * purity) / (n + prior))

    for host in {r[0] for r in rows}:
        at = [i for i, r in enumerate(rows) if r[0] == host]
        n, b = counts(at)
        walk(at, 0, [host], (b + prior * (bad + 1) / (labelled + 2)) / (n + prior))
    return out
