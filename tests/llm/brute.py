"""Plain single-machine versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def exact(texts):
    """(doc, keep, size, kept, digest)"""
    digests = [sha(SPACE.sub(" ", t or "")) for t in texts]
    groups = defaultdict(list)
    for i, d in enumerate(digests):
        groups[d].append(i)
    return [(i, groups[d][0], len(groups[d]), groups[d][0] == i, d) for i, d in enumerate(digests)]


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def jaccard(texts, size, num, den):
    """(doc, shingles, component)"""
    sets = [shingles(t, size) for t in texts]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, own in enumerate(sets):
        common = Counter(j for x in own for j in lists[x])
        for j, n in common.items():
            if den * n >= num * (len(own) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
        for x in own:
            lists[x].append(i)
    return [(i, len(s), top(i)) for i, s in enumerate(sets)]


def repeats(texts, window=200):
    """(doc, bytes, removed, spans, digest)"""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for k, d in enumerate(data):
        mark = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                mark[i : i + window] = b"\1" * window
        runs = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((k, len(d), sum(mark), runs, sha(bytes(x for x, m in zip(d, mark) if not m))))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m)


PII = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(_digits(m)) <= 15),
]


def pii(text):
    return [(k, m.start(), m.end()) for k, p, f in PII for m in p.finditer(text or "") if f(m[0])]


SECRETS = [
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def secrets(text):
    found = [(m.start(), k, n, m.end()) for k, (n, p, f) in enumerate(SECRETS) for m in p.finditer(text or "") if f(m)]
    return [(n, a, b) for a, _, n, b in sorted(found)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licenses(text, phrases):
    """(words, places, first, last, labels)"""
    words = WORD.findall((text or "").translate(LOWER))
    found = [
        (i, label) for label, phrase in phrases for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def quality(text):
    """(words, word_chars, symbols, dup_lines, repeat_words)"""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    mark = [0] * len(words)
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            mark[i : i + 8] = [1] * 8
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(mark)


def centroids(rows, k, rounds):
    """(vec, cluster, distance, cluster inertia, inertia, digest of centroid)"""
    import math
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    vectors = [(i, [math.floor(256 * single(x)) for x in v]) for i, v in rows]
    start = sorted((sha(f"2:{i}"), v) for i, v in vectors if i is not None)
    at = [v for _, v in start[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in vectors:
            groups[nearest(v)[1]].append(v)
        at = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(at)]
    found = [(i, *nearest(v)[::-1]) for i, v in vectors]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), sha(",".join(map(str, at[j])))) for i, j, d in found]


def one_apart(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spellings(rows):
    """(word, form, root, n, near, n of form)"""
    import zlib

    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


ASIDE = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets ad ads adbox advert adverts"
    " advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert"
    " popup modal overlay newsletter subscribe subscription signup social share sharing comment comments commentlist reply replies"
    " respond discussion disqus form login search related recommended recommendations pagination pager toolbar tags copyright".split()
)
READERS = set("comment comments commentlist reply replies respond discussion disqus".split())


class _Tree:
    """A well-formed page as nested elements: tag, classes, children; texts are (text, linked characters)."""

    def __init__(self, page):
        from html.parser import HTMLParser

        root = {"tag": "page", "class": [], "kids": [], "up": None}
        state = {"at": root, "link": 0}

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                if tag == "a":
                    state["link"] = 1
                    return
                made = {"tag": tag, "class": (dict(attrs).get("class") or "").split(), "kids": [], "up": state["at"]}
                state["at"]["kids"].append(made)
                state["at"] = made

            def handle_endtag(self, tag):
                if tag == "a":
                    state["link"] = 0
                else:
                    state["at"] = state["at"]["up"]

            def handle_data(self, data):
                state["at"].setdefault("text", []).append((data, state["link"]))

        Reader().feed(page)
        self.body = root["kids"][0]
        self.blocks = []
        self._collect(self.body)

    def _collect(self, e):
        if "text" in e:
            text, linked = "".join(t for t, _ in e["text"]).strip(), sum(len(t) for t, link in e["text"] if link)
            self.blocks.append((e, text, linked, max(0, len(text) - 2 * linked)))
        for kid in e["kids"]:
            self._collect(kid)

    def around(self, e):
        out = []
        while e["up"] is not None:
            out.append(e)
            e = e["up"]
        return out[::-1]  # body first

    def grade(self, e):
        """0: part of the page, 1: perhaps not, 2: probably not, 3: surely not."""
        inside = any(x["tag"] in ("article", "main") for x in self.around(e)[:-1])
        if e["tag"] in ("nav", "footer") or e["tag"] == "header" and not inside:
            return 3
        names = [re.findall("[a-z]+", c) for c in e["class"]]
        names = [n for n in names if n and n[0] != "has"]
        ends = {w for n in names for w in (n[0], n[-1])}
        least = 1 if e["tag"] == "form" else 0
        if e["tag"] in ("article", "main"):
            return 3 if ends & {"comments", "ad"} else 0
        if ends & READERS:
            return 3
        if ends & ASIDE and not any(w in ("post", "content") for n in names for w in n):
            return max(least, 2 if any(len(n) == 1 and n[0] in ASIDE for n in names) else 1)
        return least

    def kept(self):
        sure = lambda e: any(self.grade(x) == 3 for x in self.around(e))
        total = sum(w for e, _, _, w in self.blocks if not sure(e))
        graded = {}

        def out(e):
            if id(e) not in graded:
                g = self.grade(e)
                own = sum(w for b, _, _, w in self.blocks if any(x is e for x in self.around(b)) and not sure(b))
                holds = g < 2 or self.heads(e)
                graded[id(e)] = g == 3 or g in (1, 2) and not (2 * own > total and own >= 200 and holds)
            return graded[id(e)]

        return [b for b in self.blocks if not any(out(x) for x in self.around(b[0]))]

    def heads(self, e):
        """An article, main or first heading that is not surely or perhaps aside itself, reached through no lesser mark."""
        for kid in e["kids"]:
            g = self.grade(kid)
            if g == 0 and (kid["tag"] in ("article", "main", "h1") or self.heads(kid)):
                return True
            if g in (1, 2) and g == 2 and self.heads(kid):
                return True
        return False

    def path(self, e):
        steps = [x for x in self.around(e) if x["tag"] not in ("p", "h1")]
        label = lambda x: ".".join([x["tag"], *sorted({re.sub(r"[0-9_-]*[0-9][0-9_-]*", "", c) for c in x["class"]} - {""})])
        return "/".join(map(label, steps))


def _html_scores(tree):
    scores = Counter()
    for e, _, _, w in tree.kept():
        path, share = tree.path(e), float(w)
        while path:
            scores[path] += share
            path, share = path.rpartition("/")[0], share * 0.6
    return scores


def html_best(page):
    """Path of the best container."""
    scores = _html_scores(_Tree(page))
    if not scores:
        return None
    top = max(scores.values())
    path = max((p for p in scores if abs(scores[p] - top) < 1e-9 * max(1, top)), key=lambda p: (len(p), p))
    steps = path.split("/")
    for i, step in enumerate(steps):
        if step.split(".")[0] in ("article", "main"):
            return "/".join(steps[: i + 1])
    return path


def html_text(page, winning):
    """The text of the article."""
    tree, path = _Tree(page), html_best(page)
    if path is None:
        return ""
    scores = _html_scores(tree)
    for name in winning:
        if scores.get(name, 0) > 0 and scores[name] >= 0.25 * scores[path]:
            path = name
            break
    blocks = [(tree.path(e), text, linked, e["tag"] == "h1") for e, text, linked, _ in tree.kept()]
    under = lambda p, outer: p == outer or p.startswith(outer + "/")
    chosen = {i for i, b in enumerate(blocks) if under(b[0], path)}
    met, alone = set(chosen), any(s.split(".")[0] in ("article", "main") for s in path.split("/"))
    outer = path.rpartition("/")[0]
    while outer:
        new = [i for i, b in enumerate(blocks) if under(b[0], outer) and i not in met]
        met.update(new)
        new = [i for i in new if blocks[i][3] or blocks[i][2] < len(blocks[i][1])]
        if alone or "/" not in outer:
            new = [i for i in new if blocks[i][0] == outer]
        if sum(len(blocks[i][1]) - (0 if blocks[i][3] else 2 * blocks[i][2]) for i in new) < 0:
            break
        chosen.update(new)
        outer = outer.rpartition("/")[0]
    return "\n".join(blocks[i][1] for i in sorted(chosen))
