"""Plain versions of what the operators compute, straight from the contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def lowered(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def components(docs: list[dict]) -> list[tuple]:
    """Per document (n_shingles, component_id, links, group number)."""
    sets = []
    for d in docs:
        w = space_words(lowered(d["text"]))
        sets.append(frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)))
    label, links = list(range(len(docs))), [0] * len(docs)

    def top(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                label[top(i)] = top(j)
    ids = defaultdict(list)
    for i, d in enumerate(docs):
        ids[top(i)].append(d["doc_id"])
    low = {t: min((x for x in v if x is not None), default=None) for t, v in ids.items()}
    return [(len(s), low[top(i)], links[i], top(i)) for i, s in enumerate(sets)]


def contamination(docs: list[dict], items: list[dict]) -> list[tuple]:
    windows = defaultdict(set)
    for item in items:
        w = alnum_words(item["text"])
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(item["item_id"])
    out = []
    for d in docs:
        w, hit, found = alnum_words(d["text"]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    found |= got
                    hit.update(range(i, i + n))
        ids = ",".join(sorted(map(str, found)))
        out.append((len(w), len(hit), len(found), sha(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def licenses(docs: list[dict]) -> list[tuple]:
    out = []
    for d in docs:
        w = alnum_words(d["text"])
        at = [(i, k) for k, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in at]
        out.append((len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in at}))))
    return out


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets(text: str | None) -> tuple:
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, t, re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*[sum(s[1] == k for s in spans) for k in range(3)], sha(told), told)


def held_out(doc: dict, parts: int) -> bool:
    return zlib.crc32(str(doc["doc_id"] if doc["doc_id"] is not None else "").encode()) % parts == 1


def bigram_scores(docs: list[dict], discounts) -> list[tuple]:
    texts = [space_words(lowered(d["text"])) + ["</s>"] for d in docs]
    count, pairs = Counter(), Counter()
    for d, w in zip(docs, texts, strict=True):
        if not held_out(d, 5):
            count.update(w)
            pairs.update(zip(["<s>"] + w[:-1], w, strict=True))
    total, types = sum(count.values()), len(count)
    context, kinds = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (v, w), n in pairs.items():
        context[v][0] += n
        context[v][min(n, 3)] += 1
        kinds[w] += 1
    seen, seen_kinds, all_kinds = Counter(pairs.values()), Counter(kinds.values()), sum(kinds.values())
    d2 = discounts(*[seen[k] for k in (1, 2, 3, 4)])
    d1 = discounts(*[seen_kinds[k] for k in (1, 2, 3, 4)])
    rest = (d1[1] * seen_kinds[1] + d1[2] * seen_kinds[2] + d1[3] * (types - seen_kinds[1] - seen_kinds[2])) / all_kinds

    def p(v: str, w: str) -> float:
        low = max(kinds[w] - d1[min(kinds[w], 3)], 0) / all_kinds + rest / (types + 1)
        if v not in context:
            return low
        x, n = context[v], pairs[v, w]
        return max(n - d2[min(n, 3)], 0) / x[0] + (d2[1] * x[1] + d2[2] * x[2] + d2[3] * x[3]) / x[0] * low

    out = []
    for d, w in zip(docs, texts, strict=True):
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (types + 1))) for t in w)
        score = sum(math.log10(p(v, t)) for v, t in zip(["<s>"] + w[:-1], w, strict=True))
        out.append((held_out(d, 5), len(w), sum(count[t] > 0 for t in w), total, base, score))
    return out


def repeats(docs: list[dict]) -> list[tuple]:
    last = 2**63 - 1
    texts = [(d["doc_id"] if d["doc_id"] is not None else last, (d["text"] or "").encode()) for d in docs]
    low: dict[bytes, int] = {}
    for k, b in texts:
        for i in range(len(b) - 49):
            low[b[i : i + 50]] = min(low.get(b[i : i + 50], last), k)
    out = []
    for k, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if low[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g))))
    return out
