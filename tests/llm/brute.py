"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import xxhash

SPACE = " \t\n\x0b\x0c\r"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def exact(rows):
    """[(doc_id, text)] -> sorted [(doc_id, keep_id, size, kept, sha)]."""
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in SPACE)].append((i, len(t or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, sha(norm)) for i, _ in members]
    return out


def fingerprint(text) -> int:
    w = [x for x in re.split(f"[{SPACE}]+", (text or "").translate(AZ)) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(fps: list[tuple], threshold: int = 4):
    """[(doc_id, fp)] -> {fp: smallest doc_id reachable}."""
    known = sorted({f for _, f in fps})
    parent = {f: f for f in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= threshold:
                parent[find(a)] = find(b)
    least: dict = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in known}


def repeats(texts: list[bytes], length: int):
    """[(bytes, removed, spans, kept sha)] of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        starts = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), starts, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())))
    return out


def leaks(docs, items, width: int = 10):
    """[(doc_id, n_words, n_hit, n_items, ids sha, contaminated)] in the order of docs."""
    words = [WORD.findall((t or "").translate(AZ)) for _, t in docs]
    hit, ids = [set() for _ in docs], [set() for _ in docs]
    for item, t in items:
        w = WORD.findall((t or "").translate(AZ))
        n = min(width, len(w))
        for s in range(max(0, len(w) - n + 1) if n else 0):
            for i, d in enumerate(words):
                for at in range(len(d) - n + 1):
                    if d[at] == w[s] and d[at : at + n] == w[s : s + n]:
                        hit[i].update(range(at, at + n))
                        ids[i].add(str(item))
    return [(doc, len(w), len(h), len(k), sha(",".join(sorted(k))), bool(h)) for (doc, _), w, h, k in zip(docs, words, hit, ids)]


def lines(rows, min_docs: int):
    """[(doc_id, n_lines, n_dropped, kept sha)] in the order of rows."""
    keys = [[x.strip(SPACE).translate(AZ) for x in (t or "").split("\n")] for _, t in rows]
    often = Counter(k for ks in keys for k in set(ks))
    out = []
    for (i, t), ks in zip(rows, keys):
        drop = [len(k) >= 1 and often[k] >= min_docs for k in ks]
        kept = "\n".join(x for x, d in zip((t or "").split("\n"), drop) if not d)
        out.append((i, len(ks), sum(drop), sha(kept)))
    return out


def private(text) -> list[str]:
    """Personal data of the tables' forms, word by word."""
    out, words = [], (text or "").split()
    for i, w in enumerate(words):
        bare = w.strip(".,;:!?\"'")
        if bare.isdigit() and 13 <= len(bare) <= 19:
            total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(bare)))
            out += [bare] if total % 10 == 0 else []
        elif "@" in bare[1:] and "." in bare.split("@")[-1]:
            out.append(bare)
        elif bare.count(".") == 3 and all(p.isdigit() and int(p) < 256 and str(int(p)) == p for p in bare.split(".")):
            out.append(bare)
        elif w == "+1" and i + 2 < len(words) and words[i + 1].startswith("("):
            out.append(" ".join(words[i + 1 : i + 3]).rstrip(".,;"))
        elif w in ("=",) and i and words[i - 1].lower() in ("token", "password", "secret", "api_key") and i + 1 < len(words):
            out.append(words[i + 1].strip("\"'"))
        elif "password=" in w:
            out.append(w.split("password=")[1])
    return out


class Article(HTMLParser):
    """The blocks inside <article>, as a browser parts them; for pages that mark their text so."""

    PARTS = frozenset("article p div h1 h2 h3 h4 ul ol li br table tr td section blockquote".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.blocks = 0, [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.blocks += [text] if text and self.inside else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in self.PARTS:
            self.flush()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.PARTS:
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.parts.append(data)


def article(page) -> str:
    reader = Article()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return "\n\n".join(reader.blocks)
