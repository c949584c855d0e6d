"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WS = re.compile(r"[^\x20\x09-\x0D]+")


def op6(rows):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for d, t in rows:
        n = len(sp.encode(t or ""))
        out.append((d, len((t or "").encode()), n, n > 4096))
    return out


def op8(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = WS.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(windows)
        covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WS.search(x)]
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    return out


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def op2(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(fold(t or ""))
        if w:
            k = min(13, len(w))
            for s in range(len(w) - k + 1):
                windows[tuple(w[s : s + k])].add(i)
    lengths = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = word.findall(fold(t or ""))
        hit, found = set(), set()
        for k in lengths:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in windows:
                    hit.update(range(s, s + k))
                    found |= windows[x]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def op9(rows):
    starts = {}
    words = [(d, WS.findall(t or "")) for d, t in rows]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - 12):
                x = tuple(w[i : i + 13])
                starts[x] = min(d, starts.get(x, d))
    out = []
    for d, w in words:
        gone = set()
        if d is not None:
            for i in range(len(w) - 12):
                if starts[tuple(w[i : i + 13])] < d:
                    gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def op10(rows):
    import xxhash

    prints = []
    for d, t in rows:
        w = WS.findall(fold(t or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        f = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        prints.append((d, f))
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            r = find(f)
            least[r] = min(d, least.get(r, d))
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in prints]
