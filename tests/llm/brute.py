"""Plain versions of the operators, for small inputs."""

import hashlib


def repeated_bytes(docs, length=50):
    """docs: [(id, text)]. (id, n_bytes, n_removed, n_spans, sha256 of the rest) for each."""
    first = {}
    big = 2**63 - 1
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k:k + length]
            first[s] = min(first.get(s, big), big if i is None else i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < (big if i is None else i):
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def repeated_words(docs, n=13):
    first, big, split = {}, 2**63 - 1, []
    for i, t in docs:
        w = (t or "").encode().split()
        split.append(w)
        for k in range(len(w) - n + 1):
            s = tuple(w[k:k + n])
            first[s] = min(first.get(s, big), big if i is None else i)
    out = []
    for (i, _), w in zip(docs, split):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < (big if i is None else i):
                gone[k:k + n] = [True] * n
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def simhash(text):
    import xxhash

    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_components(docs, distance=3):
    """[(id, text)] without null ids: {(id, hex, component)}, by comparing all pairs."""
    fps = [simhash(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return {(i, f"{fps[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(docs)}
