"""Plain versions of the operators, in Python sets and lists."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(rows):
    """{id: (set size, component)}"""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        common = Counter(j for g in s for j in where[g] if j < i)
        for j, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contaminated(rows, items, share=0.8):
    tests = {k: shingles(t) for k, t in items}
    return {(i, k): len(s & g) for i, t in rows for s in [shingles(t)] for k, g in tests.items() if g and len(s & g) >= share * len(g)}


def repeats(rows, window=50):
    """{id: (words, removed, kept words joined)}; later rows of one id don't occur."""
    first = {}
    split = {i: words(t) for i, t in rows}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def line_dedup(rows, min_docs, leading=3, least=3, constant=60):
    """{id: (lines, dropped, text)}"""
    mask = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in words(line))
    lines = {i: [(line, mask(line)) for line in t.split("\n")] for i, t in rows if t is not None}
    heavy = Counter()
    for ls in lines.values():
        for m in {m for _, m in ls if len(m) >= least}:
            heavy.update((len(m), m[:leading], k, w) for k, w in enumerate(m) if w != "<*>")
    template = {}
    for ls in lines.values():
        for _, m in ls:
            fixed = tuple((k, w) for k, w in enumerate(m) if len(m) >= least and heavy[len(m), m[:leading], k, w] >= min_docs)
            if fixed and len(fixed) * 100 >= constant * len(m):
                template[m] = (len(m), m[:leading], fixed)
    docs = defaultdict(set)
    for i, ls in lines.items():
        for _, m in ls:
            if m in template:
                docs[template[m]].add(i)
    exact = defaultdict(set)
    for i, ls in lines.items():
        for s, _ in ls:
            exact[tuple(words(s))].add(i)

    def drop(i, s, m):
        own = exact[tuple(words(s))]
        return bool(m) and (m in template and len(docs[template[m]]) >= min_docs and i != min(docs[template[m]]) or len(own) >= min_docs and i != min(own))

    return {i: (sum(bool(m) for _, m in ls), sum(drop(i, s, m) for s, m in ls), "\n".join(s for s, m in ls if not drop(i, s, m))) for i, ls in lines.items()}


def toxicity_score(text, weights, offset, base, bucket_of_word, bucket_of_gram, grams):
    """The forward pass of the averaged embeddings, word by word."""
    found = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not found:
        return base
    total = 0.0
    for w in found:
        marked = f" {w} "
        buckets = [bucket_of_word(w)] + [bucket_of_gram(marked[i : i + k]) for k in grams for i in range(len(marked) - k + 1)]
        total += sum(weights[b] for b in buckets) / len(buckets)
    from math import exp

    return 1 / (1 + exp(-(total / len(found) + offset)))


def language(texts, labelled, grams, bucket_of, buckets):
    """The most probable language of each text by sums over n-grams; labelled: (text, language)."""
    from math import log

    fold = lambda t: "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in t)
    each = lambda t: [bucket_of(f"  {' '}{fold(t)}   "[i : i + k]) for k in grams for i in range(len(t) + 3)]
    counts = defaultdict(Counter)
    for t, g in labelled:
        counts[g].update(each(t))
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append("und")
            continue
        own = each(t)
        score = {g: sum(log((c[b] + 0.5) / (sum(c.values()) + 0.5 * buckets)) for b in own) for g, c in counts.items()}
        out.append(min(score, key=lambda g: (-score[g], g)))
    return out
