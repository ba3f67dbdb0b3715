"""Plain Python definitions that the operators are held against."""

import hashlib
import math
import re
import zlib

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingle_set(text, k):
    w = spaced(text, True)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(rows, k, percent):
    """Group number of each row (id, text); None without words."""
    sets = [shingle_set(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    return [g if s else None for g, s in zip(group, sets, strict=True)], sets


def hits(text, items):
    w = alnum(text)
    hit, found = [False] * len(w), set()
    for name, item in items:
        words = alnum(item)
        n = min(10, len(words))
        windows = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in windows:
                hit[i:i + n] = [True] * n
                found.add("" if name is None else str(name))
    return len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)


def repeats(rows, span=13):
    """(n_words, n_removed, kept_sha256) of each row (id, text)."""
    first = {}
    for i, t in rows:
        w = spaced(t)
        for j in range(len(w) - span + 1 if i is not None else 0):
            g = tuple(w[j:j + span])
            first[g] = min(first.get(g, i), i)
    for i, t in rows:
        w = spaced(t)
        gone = [False] * len(w)
        for j in range(len(w) - span + 1):
            if i is not None and first[tuple(w[j:j + span])] < i:
                gone[j:j + span] = [True] * span
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def mixture(rows, entropy, repeats_):
    """(id, source, block) of rows (id, text, source), by halving the exponent."""
    sources = {}
    for i, t, s in rows:
        sources.setdefault(s or "", []).append((i, len(spaced(t))))
    totals = {s: sum(n for _, n in d) for s, d in sources.items()}
    p = {s: t / sum(totals.values()) for s, t in totals.items() if t}

    def weights(a):
        z = sum(x**a for x in p.values())
        return {s: x**a / z for s, x in p.items()}

    def halved(enough):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if enough(weights(mid)) else (low, mid)
        return low

    a = halved(lambda w: -sum(x * math.log(x) for x in w.values()) >= entropy * math.log(len(p)))
    most, least = max(p.values()), min(p.values())
    a = max(a, 0 if most / least <= repeats_ else 1 - math.log(repeats_) / math.log(most / least))
    w = weights(a)
    budget = max(totals[s] / w[s] for s in p)  # the least repeated source once
    out = []
    for s, docs in sources.items():
        wanted = round(w[s] * budget) if s in p else 0
        whole = wanted // totals[s] if s in p else 1
        out += [(i, s, b) for b in range(whole) for i, _ in docs]
        rest, at = wanted - whole * totals[s], 0
        for i, n in sorted(docs, key=lambda d: hashlib.md5(f"{s}/{whole}/{'' if d[0] is None else d[0]}".encode()).hexdigest()):
            if at < rest:
                out.append((i, s, whole))
            at += n
    return sorted(out, key=str)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def merkle(rows, arity, change):
    """(id, leaf, subroot, root, proof, folded root, verified) of rows (id, source, lang, n_chars, text); ``change(id, text)``: the tampered text."""
    def climb(nodes):
        """Top digest, and each lowest node's (left, right) level by level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for p, i in zip(paths, at, strict=True):
                run = i - i % arity
                p.append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + arity])))
            nodes, at = [sha(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)], [i // arity for i in at]
        return nodes[0], paths

    leaves = sorted(((r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, sha(*map(framed, r))), r) for r in rows)
    sources = []
    for key, r in leaves:
        if not sources or sources[-1][0] != key[:2]:
            sources.append((key[:2], []))
        sources[-1][1].append((key[4], r))
    trees = [climb([leaf for leaf, _ in s]) for _, s in sources]
    root, above = climb([top for top, _ in trees]) if trees else (None, [])
    for (_, s), (top, paths), rest in zip(sources, trees, above, strict=True):
        for (leaf, r), own in zip(s, paths, strict=True):
            h, path = sha(*map(framed, (*r[:4], change(r[0], r[4])))), own + rest
            for left, right in path:
                h = sha(left, h, right)
            yield r[0], leaf, top, root, sha(*(x + y for x, y in path)), h, h == root
