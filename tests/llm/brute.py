"""Plain versions of the operators, for small fixtures."""

import hashlib
import html.parser
import math
import re
import string
import zlib

import numpy as np

from quillspark.llm.substring_dedup import tie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def quality(text):
    x = text or ""
    w = WORD.findall(x)
    lines = [line for line in x.split("\n") if WORD.search(line)]
    seen = {}
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    cover = {i for v in seen.values() if len(v) > 1 for k in v for i in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def base_spans(text):
    x = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16]
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(out))


def battery(token):
    """The three tests' statistic of a token and its length, padding apart."""
    upper, lower, digits = string.ascii_uppercase, string.ascii_lowercase, string.digits
    encodings = [("[0-9A-F]+", digits + "ABCDEF"), ("[0-9a-f]+", digits + "abcdef"), ("[A-Z2-7]+", upper + "234567"), ("[A-Z0-9]+", digits + upper), ("[a-z0-9]+", digits + lower), ("[A-Za-z0-9]+", upper + lower + digits), (".+", upper + lower + digits + "+/")]
    tail = lambda z: 1 / (1 + math.exp(min(700, 1.5976 * z + 0.07056 * z**3)))
    kind = lambda c: 0 if c in upper else 1 if c in lower else 2 if c in digits else 3
    t = token.rstrip("=")
    alphabet = next(a for p, a in encodings if re.fullmatch(p, t))
    if len(alphabet) == 64:
        t = t.replace("-", "+").replace("_", "/").replace("=", "/")
    n, size = len(t), len(alphabet)
    x = np.array([alphabet.index(c) for c in t])
    bins = max(2, min(size, n // 5))
    expected = n * np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    chi, free = ((np.bincount(x * bins // size, minlength=bins) - expected) ** 2 / expected).sum(), bins - 1
    z_chi = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    kinds = [kind(c) for c in t]
    same = sum((sum(kind(c) == k for c in alphabet) / size) ** 2 for k in range(4))
    z_runs = (sum(a != b for a, b in zip(kinds, kinds[1:])) - (n - 1) * (1 - same)) / math.sqrt((n - 1) * same * (1 - same))
    d = x - x.mean()
    z_serial = ((d[:-1] * d[1:]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n) if (d * d).sum() else 99
    tests = tail(z_chi), min(1, 2 * tail(abs(z_runs))), min(1, 2 * tail(abs(z_serial)))
    return -2 * sum(math.log(max(p, 1e-12)) for p in tests), n


def random_tokens(tokens, fdr=0.01, alpha=1e-3, mean=1.3, deviation=0.36):
    """Those of a text's tokens that are found random, by Benjamini-Hochberg."""
    tail = lambda z: 1 / (1 + math.exp(min(700, 1.5976 * z + 0.07056 * z**3)))
    scored = []
    for t in tokens:
        y, n = battery(t)
        scored.append((tail((mean * n - y) / (deviation * n)), math.exp(-y / 2) * (1 + y / 2 + y * y / 8), t))
    ps = sorted(p for p, _, _ in scored)
    bar = max((p for i, p in enumerate(ps) if p <= fdr * (i + 1) / len(ps)), default=-1)
    return [t for p, q, t in scored if p <= bar and q >= alpha]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """{id: least id of its component} of (id, text)."""
    sets = {}
    up = {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, t in rows:
        up.setdefault(i, i)
        sets.setdefault(i, []).append(shingles(t))
    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for a, (i, s) in enumerate(flat):
        for j, r in flat[:a]:
            if i != j and 100 * len(s & r) >= 75 * len(s | r):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def repeats(rows, length=100):
    """{index: (n_bytes, n_removed, n_spans, sha)} of (key, text), null keys first, rows of one key by the hash of their text."""
    seen, out = set(), {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, tie((rows[k][1] or "").encode())))
    for k in order:
        b = (rows[k][1] or "").encode()
        mask = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                mask[s : s + length] = True
            seen.add(b[s : s + length])
        runs = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        out[k] = len(b), int(mask.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()
    return out


def targets(sizes):
    """{source: target} of {source: words}, weights 1, 2, 3 by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full, got = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        got = {s: 3.0 * sizes[s] for s in full} | {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if got[s] > 3 * sizes[s]]
        if not over:
            return got
        full |= set(over)


class _Article(html.parser.HTMLParser):
    """The text of a page's article by its tags, a line for each block."""

    BREAKS = set("article div p h1 h2 h3 ul ol li table tr td blockquote section figure figcaption pre".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.lines = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style", "nav", "footer", "aside", "form")
        if tag in self.BREAKS:
            self.lines.append("")
        elif tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style", "nav", "footer", "aside", "form")
        if tag in self.BREAKS:
            self.lines.append("")

    def handle_data(self, data):
        if self.depth > 0 and not self.skip:
            self.lines[-1] += data


def article(page):
    p = _Article()
    p.feed(page)
    p.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in p.lines) if x)


def contamination(text, items, span=10):
    """(n_words, n_hit, n_items, sha, contaminated) of a text against (id, text)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    w, hit, found = split(text), set(), set()
    for i, t in items:
        x = split(t)
        n = min(span, len(x))
        own = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in own:
                hit |= set(range(k, k + n))
                found.add("" if i is None else str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def damaged(turns):
    """{conversation: damaged (turn, role, text) in order} of (conv, turn, role, text)."""
    out = {}
    for c, turn, role, text in turns:
        name = lambda x: " " if x is None else str(x)
        mine, kind = out.setdefault(c, []), zlib.crc32(f"{name(c)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rows in out.items()}


def edits(kinds):
    """(cost, audit) of (initial, fault) in order, the least of all by trying each edit from the end."""
    to = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
    for initial, fault in reversed(kinds):
        row = {}
        for s in range(4):
            ways = [(best[s][0] + 4, "D" + best[s][1])]
            if fault not in ("blank", "duplicate"):
                more, kept = 3 * (fault == "truncated"), 1 if (s, initial) == (0, "s") else to[s] if initial == "ua"[s == 2] else None
                ways.append((best[to[s]][0] + 3 + more, "R" + best[to[s]][1]))
                if kept:
                    ways.append((best[kept][0] + more, "K" + best[kept][1]))
            row[s] = min(ways)
        for _ in range(3):
            row = {s: min(row[s], (row[to[s]][0] + 3, "I" + row[to[s]][1])) for s in row}
        best = row
    return best[0]


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of a conversation's (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        visible = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = edits([(role[:1], f) for (_, role, _), f in zip(rows, faults, strict=True)])
    left, out, state = list(rows), [], 0
    for e in audit:
        _, role, text = left.pop(0) if e != "I" else (0, "", "")
        if e != "D":
            out.append((role if e == "K" else "assistant" if state == 2 else "user") + ":" + text)
            state = 1 if e == "K" and role[:1] == "s" else 3 if state == 2 else 2
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def hard_negatives(rows, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) of (id, vector, label), by every pair."""
    whole = [(i, np.array([math.floor(256 * float(np.float32(x))) for x in v]), (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(whole):
        if i is None or i % 100:
            continue
        dot = lambda u, v=v: int(u[: len(v)] @ v[: len(u)])
        scored = sorted(((-dot(u), j is None, j or 0, b, z) for b, (j, u, z) in enumerate(whole) if b != a))
        for s, _, j, b, _ in [x for x in scored if x[4] == y][:positives]:
            fits = [x for x in scored if x[4] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, whole[b][0], k + 1, whole[x[3]][0], -s, -x[0]) for k, x in enumerate(fits)]
    return out
