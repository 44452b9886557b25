"""Plain Python versions of the contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def base_lm(docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    toks = [(i, WORD.findall(lower(t or "")) + [None]) for i, t in docs]
    c = Counter(w for i, ws in toks if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in toks}


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def judge_url(url, rules=RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host):])[0]
    best = None
    for v, k in rules:
        h, s, p = k.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(k) > len(best[1])):
            best = (v, k)
    return host, path, best and best[1], best[0] if best else "allow"


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def conversations(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def luhn(d):
    s = 0
    for k, ch in enumerate(reversed(d)):
        x = int(ch) * (1 + k % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    out = []
    for k, p in PII.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def copies(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[normal(t)].append(i)
    return {i: (min(groups[normal(t)]), len(groups[normal(t)]), i == min(groups[normal(t)]), sha(normal(t))) for i, t in docs}


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    rep = {i + k for ps in at.values() if len(ps) > 1 for i in ps for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), n < 50 or 100 * len(rep) > 50 * n


def spellings(docs, least=7):
    """op13 over (doc_id, text) rows: word -> (form, root, n, n_near, form_n)."""
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            near[w] |= holes[w[:i], w[i + 1 :]] - {w}
            if (d := w[:i] + w[i + 1 :]) in n:
                near[w].add(d)
                near[d].add(w)
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * c else None
    out = {}
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        out[w] = (form[w], r, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def lloyd(rows, k=40, rounds=5, dim=64):
    """op12 over (vec_id, vector) rows, plainly: list of output rows."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(256 * c) for c in v]))
    start = sorted(kept, key=lambda r: (sha(f"2:{'' if r[0] is None else r[0]}"), r[1]))[:k]
    cents = [x for _, x in start]

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in cents]
            out.append((min(d), d.index(min(d))))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(cents)):
            mine = [x for (_, x), (_, a) in zip(kept, at) if a == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine)]
    at = assign()
    per = Counter()
    for d, c in at:
        per[c] += d
    return [(i, c, d, per[c], sum(per.values()), sha(",".join(map(str, cents[c])))) for (i, _), (d, c) in zip(kept, at)]
