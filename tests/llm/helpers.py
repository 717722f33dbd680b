"""Plain versions of the operators, straight from their definitions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import xxhash


def rows(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def lines(docs):
    """docs: (id, text). Contract of line dedup."""
    key = lambda x: x.strip(b" \t\n\r\x0b\x0c").lower()
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").encode().split(b"\n"):
            if len(key(x).decode()) >= 20:
                held[key(x)].add(-(2**63) if d is None else d)
    out = []
    for d, t in docs:
        parts = (t or "").encode().split(b"\n")
        left = [x for x in parts if not (len(held.get(key(x), ())) >= 3 and (-(2**63) if d is None else d) != max(held[key(x)]))]
        out.append((d, len(parts), len(parts) - len(left), hashlib.sha256(b"\n".join(left)).hexdigest()))
    return out


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def groups(fps, radius=4):
    """Number of neighbours and least index reachable of each."""
    n = len(fps)
    near = [[j for j in range(n) if j != i and (fps[i] ^ fps[j]).bit_count() <= radius] for i in range(n)]
    low = list(range(n))
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        low[i] = min(seen)
    return [len(x) for x in near], low


def substrings(docs, length):
    """docs in order: bytes that a repeated string covers go."""
    seen, out = set(), []
    for text in docs:
        gone = [False] * len(text)
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if w in seen:
                gone[i : i + length] = [True] * length
            seen.add(w)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(text), sum(gone), runs, bytes(c for c, g in zip(text, gone) if not g)))
    return out


def unigrams(docs):
    """docs: (id, text). N and each text's base score and known tokens."""
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(x for d, t in docs if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(d, held(d), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t))) for d, t in docs]


def bigrams(docs, strength=4.0):
    """docs: (id, text). Each text's score under the pair model, with counts as the filter's levels show them; and the model."""
    least = sorted({1, *(x << k for x in (2, 3) for k in range(40))})
    low = lambda c: max((x for x in least if x <= c), default=0)
    high = lambda c: next(x for x in least if x > c) - 1 if c else 0
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    trained = [tokens(t) for d, t in docs if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    word, context, pair, kept = Counter(), Counter(), Counter(), Counter()
    for t in trained:
        word.update(t)
        context.update([None, *t])
        pair.update(zip([None, *t], t))
    context[b""] = word[b""]  # the end counts as a context that nothing follows
    for (v, _), c in pair.items():
        kept[v] += c if c > 1 else 0
    n, size = sum(word.values()), len(word)

    def p(v, w):
        c = pair[v, w]
        single = (low(word[w]) + 1) / (n + size + 1)
        return (low(c if c > 1 else 0) + (strength + low(context[v] - kept[v])) * single) / (high(context[v]) + strength)

    return [(d, sum(math.log10(p(v, w)) for v, w in zip([None, *tokens(t)], tokens(t)))) for d, t in docs], p, word
