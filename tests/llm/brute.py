"""Plain Python versions of the operators, straight from their definitions, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    hit = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            len(w) < 20 or 100 * len(hit) > 30 * len(w))


def url_verdict(url: str | None, rules: list[tuple[str, str]]) -> tuple:
    """host, path, rule, verdict of the base rules."""
    host = path = ""
    if url is not None and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, tail = rest.partition("/")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = slash + tail
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), cap=3) -> dict:
    """Water filling by rounds."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s: float(cap * sizes[s]) for s in free if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {**capped, **share}
        capped.update(over)
        if len(capped) == len(names):
            return capped


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def jaccard(docs: list[tuple[int, str | None]], threshold: float = 0.8) -> dict:
    """id -> (class id, links) by comparing all pairs; ids must differ."""
    sets = [(i, shingles(t)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and len(s & t) >= threshold * len(s | t) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i, _ in sets}


def pii_base(text: str | None) -> list[str]:
    text = text or ""

    def luhn(d: str) -> bool:
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    checks = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in checks for m in re.finditer(p, text) if ok(m[0])]


def backoff(docs: list[tuple[int, str | None]], alpha: float = 0.4) -> dict:
    """id -> (words, backed-off words, score) with bigrams, leaving the document out."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    one, two = Counter(), Counter()
    for w in words.values():
        one.update(w)
        two.update(zip(w, w[1:]))
    n = sum(one.values())
    out = {}
    for i, w in words.items():
        mine, pairs = Counter(w), Counter(zip(w, w[1:]))
        rest = max(n - len(w), 1)
        score, backed = 0.0, 0
        for k, x in enumerate(w):
            if k and two[w[k - 1], x] - pairs[w[k - 1], x] > 0:
                score += math.log((two[w[k - 1], x] - pairs[w[k - 1], x]) / (one[w[k - 1]] - mine[w[k - 1]]))
                continue
            score += math.log(max(one[x] - mine[x], 1) / rest) + (math.log(alpha) if k else 0)
            backed += bool(k)
        out[i] = (len(w), backed, score)
    return out


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def repeated_bytes(docs: list[str | None], length: int) -> list[tuple]:
    """n_bytes, n_removed, n_spans, kept_sha256 of every text."""
    data = [(t or "").encode() for t in docs]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def normal_line(line: str) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", line).lower().strip(" ")


def within_one(a: str, b: str) -> bool:
    """Edit distance of at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def lines(docs: list[tuple[int, str | None]], least: int = 20) -> dict:
    """id -> (lines with a word, equal lines, near lines); documents in order of id."""
    earlier: list[str] = []
    known: set[str] = set()
    out = {}
    for i, t in sorted(docs):
        n, equal, near = 0, [], []
        for k, x in enumerate((t or "").split("\n")):
            x = normal_line(x)
            if not x:
                continue
            n += 1
            if x in known:
                equal.append(k)
                continue
            if len(x) >= least and any(len(e) >= least and within_one(x, e) for e in earlier):
                near.append(k)
            earlier.append(x)
            known.add(x)
        out[i] = (n, equal, near)
    return out


def contamination(text: str | None, items: list[tuple[int, str | None]]) -> tuple:
    """n_words, n_hit, n_items, items_sha256, contaminated."""
    words = lambda s: BENCH_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        b = words(t)
        n = min(13, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)
