"""Plain Python forms of the operators' definitions, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), d))
    out = []
    for d, t in docs:
        bare = SPACE.sub("", t or "")
        best = min(groups[bare])[1]
        out.append((d, best, len(groups[bare]), d == best, sha(bare)))
    return sorted(out)


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def near(docs):
    sets = {}
    for d, t in docs:
        sets.setdefault(shingle_set(t), []).append(d)
    reps = [s for s in sets if s]
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)

    for s in reps:
        for d in sets[s]:
            join(d, sets[s][0])
    holders = {}
    for k, s in enumerate(reps):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, s in enumerate(reps):
        shared = Counter(j for x in s for j in holders[x] if j < k)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(reps[j]) - n):
                join(sets[s][0], sets[reps[j]][0])
    return sorted((d, len(shingle_set(t)), root(d)) for d, t in docs)


def quality(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def secrets(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text or "") if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 16]
    kinds = Counter(x[3] for x in out)
    return kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out)))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def conversation(turns):
    """turns: (turn, role, text) of one conversation; what op5 returns but formatted_chars."""
    turns = sorted((t, r or "", x or "") for t, r, x in turns)
    loss = "".join(x for _, r, x in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)


def targets(sizes, weights, most=3):
    """Shares by weight, what is above most times a size reshared, one step at a time."""
    out, full = [0.0] * len(sizes), set()
    while True:
        left = sum(sizes) - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in range(len(sizes)):
                out[i] = most * sizes[i] if i in full else left * weights[i] / total
            return out
        full |= over


def _drawn(doc_id):
    """Where a document stands in its shuffled source: a 64-bit hash, signed."""
    import struct

    import xxhash

    h = xxhash.xxh64_intdigest(b"source-mix", 42)
    if doc_id is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), h)
    return h - (1 << 64) if h >> 63 else h


def mix(rows, block, least_blocks, weights=(1, 2, 3), most=3):
    """rows: (doc_id, source, size). The mix walked slot by slot, word by word: taken of each row, in order of rows."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, s, n in rows if s == name) for name in names]
    want = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], most) if sum(sizes) else [0.0] * len(names)
    words, n_blocks, quota = [], [], []
    for name, size, target in zip(names, sizes, want):
        order = sorted((k for k, (_, s, _) in enumerate(rows) if s == name), key=lambda k: (_drawn(rows[k][0]), rows[k][0] is not None, rows[k][0] or 0, rows[k][2], k))
        words.append([k for k in order for _ in range(rows[k][2])])
        n_blocks.append(min(size, max(least_blocks, -(-size // block))))
        quota.append(min(int(target * n_blocks[-1] / max(size, 1) + 0.5), most * n_blocks[-1]))
    owner = [i for i, q in enumerate(quota) for _ in range(q)]
    bits, taken, used = max(0, len(owner) - 1).bit_length(), [0] * len(rows), [0] * len(names)
    for slot in range(1 << bits):
        point = int(f"{slot:0{bits}b}"[::-1], 2) if bits else 0
        if point >= len(owner):
            continue
        i = owner[point]
        b = used[i] % n_blocks[i]
        used[i] += 1
        for k in words[i][b * sizes[i] // n_blocks[i] : (b + 1) * sizes[i] // n_blocks[i]]:
            taken[k] += 1
    return taken


def em(rows, classes, votes, steps):
    """Expectation maximisation document by document. rows: votes of each; classes: shares;
    votes[class][rule][vote + 1]: shares. The classes' shares and each row's P(first class)."""
    import numpy as np

    x = np.array(rows) + 1
    share, v = np.array(classes, float), np.array(votes, float)
    for _ in range(steps):
        like = share * np.array([np.prod(v[:, np.arange(x.shape[1]), r], axis=1) for r in x])
        post = like / like.sum(axis=1, keepdims=True)
        share = (post.sum(axis=0) + 1 / len(share)) / (len(x) + 1)
        sums = np.full(v.shape, 1 / 3)
        for r, q in zip(x, post):
            sums[:, np.arange(x.shape[1]), r] += q[:, None]
        v = sums / sums.sum(axis=2, keepdims=True)
    like = share * np.array([np.prod(v[:, np.arange(x.shape[1]), r], axis=1) for r in x])
    return share, v, like[:, 0] / like.sum(axis=1)


OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")


def findings(rows, owners=2, repositories=100):
    """rows: (doc_id, text, source). kind:start:end of all spans, n_live and n_copied, in order of rows."""
    found, texts = [], {}
    for d, t, s in rows:
        spans = [(m.start(), 0, m.end(), "assign", m[2]) for m in ASSIGN.finditer(t or "") if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access", m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex", m[0]) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
        mixed = lambda x: re.search("[0-9]", x) and re.search("[A-Z]", x) and re.search("[a-z]", x)
        spans += [(m.start(), 3, m.end(), "opaque", m[0]) for m in OPAQUE.finditer(t or "") if mixed(m[0])]
        found.append(sorted(spans))
        for x in spans:
            texts.setdefault(x[4], {}).setdefault(s, {}).setdefault(t or "", set()).add(str(d))
    copied = set()
    for value, by in texts.items():
        # Of an owner: equal texts count once, by their smallest id, and an id once.
        n = sum(len({min(ids) for ids in of.values()}) for of in by.values())
        if len(by) >= owners or n >= repositories:
            copied.add(value)
    out = []
    for spans in found:
        shown = [x for x in spans if x[3] != "opaque" or x[4] not in copied]
        out.append((",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in shown), sum(x[4] not in copied for x in spans), sum(x[4] in copied and x[3] != "opaque" for x in spans)))
    return out


def language(profiles, text, length=300):
    """Out-of-place distance in plain Python. profiles: language -> its n-grams (tuples of code points, 0 beside a word) in order."""
    low = (text or "").lower()
    words = "".join(c if c.isalpha() else " " for c in low).split(" ")
    line = [0]
    for word in filter(None, words):
        line += [*map(ord, word), 0]
    counts = Counter((c,) for c in line if c)
    counts.update(zip(line, line[1:]))
    counts.update(zip(line, line[1:], line[2:]))
    if not counts or not profiles:
        return "und", 0.0

    def packed(g):
        n = sum(c << 21 * k for k, c in enumerate(reversed(g)))
        return n | (0, 0, 1 << 42, 1 << 62)[len(g)]

    own = sorted(counts, key=lambda g: (-counts[g], packed(g)))[:length]
    best = min((sum(abs(ranks.index(g) - k) if g in ranks else length for k, g in enumerate(own)), name) for name, ranks in profiles.items())
    return best[1], 1 - best[0] / (length * len(own))


def feistel(key, kind, n, x):
    """Eight rounds over two factors of n, walked until below n."""
    import hmac
    import math

    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for step in range(8):
            half, size = (left, b) if step % 2 else (right, a)
            f = int.from_bytes(hmac.new(key, f"{kind}|{n}|{step}|{half}".encode(), "sha256").digest(), "big")
            left, right = (left, (right + f) % b) if step % 2 else ((left + f) % a, right)
        x = left * b + right
        if x < n:
            return x


def pseudonym(key, kind, value):
    """Of a plain value of some kinds, by arithmetic."""
    import datetime as dt

    if kind == "card":
        digits = value[0] + f"{feistel(key, kind, 10 ** (len(value) - 2), int(value[1:-1])):0{len(value) - 2}d}"
        return digits + next(c for c in "0123456789" if luhn(digits + c))
    if kind == "ip":
        n = feistel(key, kind, 2**32, int("".join(f"{int(p):08b}" for p in value.split(".")), 2))
        return ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))
    if kind == "date":
        first = dt.date(1900, 1, 1)
        return str(first + dt.timedelta(feistel(key, kind, (dt.date(2100, 1, 1) - first).days, (dt.date.fromisoformat(value) - first).days)))
    areas = [a for a in range(1, 900) if a != 666]
    area, group, serial = map(int, value.split("-"))
    n = feistel(key, kind, 898 * 99 * 9999, (areas.index(area) * 99 + group - 1) * 9999 + serial - 1)
    return f"{areas[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"


def luhn(digits):
    return sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(digits))) % 10 == 0


def personal(text, key):
    """The text with pseudonyms of the plain cards, addresses, dates and numbers among its words."""
    forms = {"card": r"\d{13,19}", "ssn": r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", "ip": r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}", "date": r"(?:19|20)\d\d-(?:0\d|1[0-2])-\d\d"}

    def change(m):
        for kind, form in forms.items():
            if re.fullmatch(form, m[0]) and (kind != "card" or luhn(m[0]) and len(set(m[0])) > 1):
                return pseudonym(key, kind, m[0])
        return m[0]

    return re.sub(r"[^ ]+", change, text)
