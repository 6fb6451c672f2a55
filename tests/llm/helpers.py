"""Plain Python versions of what the operators compute."""

import collections
import hashlib
import math
import re
import unicodedata

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "  ", "\n\n", "one", "ÀÉ 日本 ▁\u0000😀", "word " * 30000]


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def words(text):
    return re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower().strip(b" \t\n\x0b\x0c\r"))


def bag(text):
    w = [x for x in words(text) if x]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def near_classes(texts):
    """Class of each id by comparing all pairs that share a shingle."""
    up = {i: i for i in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = {i: bag(t) for i, t in texts.items()}
    blank = [i for i, b in bags.items() if not b]
    holders = collections.defaultdict(set)
    for i, b in bags.items():
        for s in b:
            holders[s].add(i)
    pairs = {(a, b) for own in holders.values() for a in own for b in own if a < b} | {(blank[0], i) for i in blank[1:]}
    for a, b in pairs:
        both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
        if both >= 0.8 * either:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: top(i) for i in texts}


def line_dedup(texts):
    """(lines, dropped, kept text) per id."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = collections.defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out[i] = len(lines), len(lines) - len(kept), "\n".join(kept)
    return out


def contained(docs, items, bound=0.8):
    """(doc, item) with at least the bound of the item's distinct shingles."""
    d = {i: set(b) for i, t in docs.items() if (b := bag_unicode(t))}
    return {(i, j) for j, t in items.items() if (s := bag_unicode(t)) for i, x in d.items() if len(set(s) & x) >= bound * len(s)}


def bag_unicode(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def letter_runs(text):
    """Words of letters, lower case."""
    out = [""]
    for c in (text or "").lower():
        if c.isalpha():
            out[-1] += c
        elif (c.isdigit() or c.isnumeric() or unicodedata.category(c).startswith("M")) and not re.match(r"[\W\d_]", c):
            pass  # a sign within a word, such as 2 in superscript
        elif out[-1]:
            out.append("")
    return [w for w in out if w]


class SlowKneserNey:
    """Interpolated Kneser-Ney over the characters of words, by recursion."""

    def __init__(self, words, order, symbols):
        self.order, self.floor, self.cache = order, 1.0 / (symbols + 2), {}
        raw = [collections.Counter() for _ in range(order + 2)]
        for word, times in words.items():
            marked = f"\2{word}\3"
            for end in range(2, len(marked) + 1):
                for n in range(1, min(order, end) + 1):
                    raw[n][marked[end - n : end]] += times
        self.counts = [collections.Counter() for _ in range(order + 1)]
        for n in range(1, order + 1):
            left = collections.Counter(g[1:] for g in raw[n + 1])
            for g, c in raw[n].items():
                self.counts[n][g] = c if n == order or g[0] == "\2" else left[g]
        self.discount = [0.0]
        for n in range(1, order + 1):
            of = collections.Counter(self.counts[n].values())
            self.discount.append(of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5)
        self.after = collections.defaultdict(list)
        for n in range(1, order + 1):
            for g, c in self.counts[n].items():
                self.after[g[:-1]].append(c)

    def p(self, context, char):
        """P of a character after as much of the context as the order allows."""
        key = context, char
        if key not in self.cache:
            lower = self.p(context[1:], char) if context else self.floor
            n, follow = len(context) + 1, self.after.get(context)
            if follow:
                d = self.discount[n]
                lower = max(self.counts[n][context + char] - d, 0) / sum(follow) + d * len(follow) / sum(follow) * lower
            self.cache[key] = lower
        return self.cache[key]

    def bits(self, word):
        marked = f"\2{word}\3"
        return -sum(math.log2(max(1e-12, self.p(marked[max(0, i - self.order + 1) : i], marked[i]))) for i in range(1, len(marked)))


def slow_languages(sample, texts, order):
    """For each text its cross-entropy in each language; sample: rows (lang, text) learned from."""
    words = collections.defaultdict(collections.Counter)
    for lang, text in sample:
        words[lang].update(letter_runs(text))
    symbols = len({c for own in words.values() for w in own for c in w})
    models = {k: SlowKneserNey(own, order, symbols) for k, own in sorted(words.items())}
    out = []
    for text in texts:
        own = letter_runs(text)
        n = sum(map(len, own)) + len(own)
        out.append({k: sum(map(m.bits, own)) / n for k, m in models.items()} if n else {})
    return out
