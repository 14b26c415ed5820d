"""Plain Python versions of the corpus operators' contracts, and rows that are hard on them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DDL = "doc_id long, text string, lang string, source string, n_chars long, g int, bucket string, n long, kept string"


def sentence(k: int, words: int = 60) -> str:
    return " ".join(f"w{(i * 7 + k * 13) % 97}x{k}" for i in range(words))


def hard_rows() -> list[tuple]:
    base = sentence(1, 120)
    near = base.replace("w13x1", "changed", 1)
    texts = [
        (1, base), (2, base), (3, near), (4, "prefix " + base + " suffix"), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "Two words"), (9, "Two words"),
        (10, "two WORDS"), (11, sentence(2, 49)), (12, sentence(2, 50)), (13, sentence(2, 51)), (None, base), (14, "a b " * 400), (15, "naïve Ünï code spaces\x0bvt \x85 end"),
        (16, "x" * 5000 + " " + sentence(3, 3000)), (17, sentence(3, 3000)), (18, "line\nline\nline\n\nother\n"), (19, "<|endoftext|> and  two  spaces"), (20, sentence(4, 20) + " Mail.Me@example.com.org! 10.1.2.300 10.1.2.30 4111 1111 1111 1111 +1 (212) 555-0100 x@y 1.2.3.4.5"),
        (21, "4539578763621486 4539578763621486 token = \"0123456789abcdef0123456789abcdef01234567\""), (22, "####  $$$ %%% | <b> & *"),
    ]
    return [(d, t, "en" if (d or 0) % 3 else None, f"src{(d or 0) % 2}" if d != 8 else None, None if t is None else len(t), 1, "b", 2, "k") for d, t in texts]


def repeats(rows, window=50):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    first: dict = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, float("inf")), float("inf") if d is None else d)
    out = []
    for d, w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (float("inf") if d is None else d):
                keep[i : i + window] = [False] * window
        text = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((d, len(w), keep.count(False), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def components(rows, n, percent):
    sets = []
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((d, frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, (_, s) in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets))


def leaks(rows, items, window=10):
    wanted: dict = {}
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + window]), set()).update(() if item is None else [str(item)])
    out = []
    for d, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(w) - n + 1):
                if (s := wanted.get(tuple(w[i : i + n]))) is not None:
                    found |= s
                    hit[i : i + n] = [1] * n
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0))
    return Counter(out)


def near_leaks(rows, items, window=10, slack=2):
    phrases = set()
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.add((item, tuple(w[i : i + window])))
    first = defaultdict(list)
    for item, p in phrases:
        first[p[0]].append((item, p))
    out = []
    for d, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        found = set()
        for i, x in enumerate(w):
            for item, p in first.get(x, []):
                if item is not None and i + len(p) <= len(w) and all(p[k] in w[max(0, i + k - slack) : i + k + slack + 1] for k in range(1, len(p))):
                    found.add(str(item))
        out.append((d, tuple(sorted(found))))
    return Counter(out)


def base_spans(text):
    from tidemark.llm.pii import luhn

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def statistics(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered, seen, dup = set(), set(), 0
    for i in range(len(w) - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def outliers(rows, share=0.5, steps=3, prior=30.0, level=1e-6):
    """(doc_id: kept, distance) of rows (doc_id, text, lang, source), by numpy, group for group."""
    import numpy as np

    from tidemark.llm.robust_outliers import FLOORS, chi_square_value, consistency

    floors = np.diag(np.square(FLOORS))

    def vector(t):
        n, chars, symbols, dup, rep = statistics(t)
        digits = sum("0" <= c <= "9" for c in t or "")
        n, chars = max(n, 1), max(chars, 1)
        return [4 * (symbols / chars) ** 0.5, 8 * (dup / n) ** 0.5, 4 * (rep / n) ** 0.5, np.log(chars / n), 4 * (digits / chars) ** 0.5]

    def middle(bins):
        return np.sort(bins, axis=0)[(len(bins) - 1) // 2]

    def shrunk(n, m, c, whole):
        if whole is None:
            return m, c
        w = n / (n + prior)
        return w * m + (1 - w) * whole[0], w * c + (1 - w) * whole[1]

    def far(x, m, c):
        return np.einsum("ij,ij->i", x - m, np.linalg.solve(c, (x - m).T).T)

    def fit(x, whole):
        bins = np.floor(100 * x + 0.5)
        mid = middle(bins)
        spread = middle(np.abs(bins - mid)) / 100
        m, c = shrunk(len(x), mid / 100, np.diag((1.4826 * spread) ** 2) + floors, whole)
        for limit in [None] * steps + [chi_square_value(0.975, 5)]:
            place = np.floor(16 * np.log2(np.maximum(far(x, m, c), 1e-9)))
            if limit is None:
                end, scale = np.sort(place)[int(np.ceil(share * len(x))) - 1], consistency(share)
            else:
                end, scale = max(np.floor(16 * np.log2(limit)), place.min()), consistency(0.975)
            inner = x[place <= end]
            m, c = shrunk(len(inner), inner.mean(axis=0), scale * np.cov(inner.T, bias=True) + floors, whole)
        return m, c

    facts = [(d, (lang, source), vector(t), statistics(t)) for d, t, lang, source in rows]
    failed = {d: s[0] < 50 or 100 * s[4] > 50 * s[0] for d, _, _, s in facts}
    groups = defaultdict(list)
    for d, k, v, _ in facts:
        if not failed[d]:
            groups[k].append(v)
    whole = fit(np.array([v for vs in groups.values() for v in vs]), None)
    fitted = {k: fit(np.array(vs), whole) for k, vs in groups.items()}
    cut = chi_square_value(1 - level, 5)
    out = {}
    for d, k, v, _ in facts:
        q = far(np.array([v]), *fitted.get(k, whole))[0]
        out[d] = (bool(not failed[d] and q <= cut), q)
    return out
