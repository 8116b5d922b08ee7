"""Plain versions of the operators over dicts, and a table of awkward rows."""

import hashlib
import random
import re
from collections import Counter

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, len int, label int, token string, n_words int"


def low(s):
    return s.encode("utf-8").lower().decode("utf-8")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sentence(rng, n):
    return " ".join(rng.choice("the of and ein une los große año ouvrir Stone river Kant blue 42 x,y".split()) + rng.choice(["", "", "", ".", "a"]) for _ in range(n))


def corpus(seed=1, n=60):
    """Ordinary, copied, nearly copied, shared, empty, null and very long texts; repeated rows; a null doc_id."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 60)) for _ in range(n)]
    passage, line = sentence(rng, 70), "This Line is shared by very many of the documents here, with a tail."
    for i in range(8):
        w = texts[0].split() + passage.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{sentence(rng, 5)}\n  {line.upper() if i % 2 else line}\t\n{sentence(rng, 4)}\n{line}" for i in range(7)]
    texts += [f"{sentence(rng, 20)} {passage} {sentence(rng, 9)}" for _ in range(4)]
    texts += [texts[3], texts[3] + "  ", "\t" + texts[3], "", "   ", "\n\n", "One", "one two", "日本語 の テキスト です", "ÀÉ é", "1234 !!", "a\x00b c", "x" * 5000, " ".join(["long"] * 30_000), sentence(rng, 20_000)]
    rows = [(i * 7 % 1000 + 1, t) for i, t in enumerate(texts)]
    rows += [(2000, None), (2001, None), rows[5], rows[5]]
    return [(i, t, rng.choice(["en", "de", None]), None, None if t is None else len(t), "clash", None, 3, "clash", 1) for i, t in rows]


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return Counter((i, min(v), len(v), i == min(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for i in v)


def line_dedup(rows, chars=40, docs=5):
    key = lambda x: low(x.strip(SPACES))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                held.setdefault(key(x), set()).add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= docs and max(held[key(x)]) != i)]
        out[(i, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    return out


def substrings(rows, k=13):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for a in range(len(w) - k + 1):
            first.setdefault(tuple(w[a : a + k]), i)
    out = Counter()
    for i, t in rows:
        w = words(t)
        gone = {p for a in range(len(w) - k + 1) if first[tuple(w[a : a + k])] < i for p in range(a, a + k)}
        out[(i, " ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone))] += 1
    return out


def near(rows, k=5):
    sets = []
    for i, t in rows:
        w = [low(x) for x in words(t)]
        sets.append((i, {tuple(w[a : a + k]) for a in range(max(len(w) - k + 1, 1))} if w else set()))
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return Counter((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def contamination(rows, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    windows = {}
    for item, t in items:
        w = find(t)
        for a in range(max(len(w) - k + 1, 1)) if w else ():
            windows.setdefault(tuple(w[a : a + k]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = Counter()
    for i, t in rows:
        w, hit, found = find(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in windows:
                    found |= windows[x]
                    hit |= {*range(a, a + n)}
        out[(i, len(w), len(hit), tuple(sorted(found)))] += 1
    return out


PATTERNS = {"assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20), "hex": (re.compile("[0-9a-f]+"), 0, 24)}


def secrets(text):
    found = [(m.start(), k, m.end(), name) for k, (name, (p, g, n)) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [(name, a, z) for a, _, z, name in sorted(found)]
