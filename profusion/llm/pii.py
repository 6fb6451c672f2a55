"""PII: candidate generators, boosted trees over format and context, calibrated thresholds.

Native: DataFrame and SQL functions only; the trees are CASE expressions.

* Base kinds (email, ip, card, phone) are found by fixed patterns and checks and always stay. The
  patterns are written with possessive repeats and start conditions that find the same matches in time
  linear in the text, also on runs of one million equal characters.
* Generators of high recall propose further, overlapping spans: named secrets, long mixed codes, groups
  of digits, spelled-out addresses. Each candidate gets format features (length, digits, variety, case,
  separators, check digit) and context features (cue words before it). Boosted depth-two trees give its
  probability; each generator has a threshold calibrated for precision. Candidates are taken up from the
  most probable down, and one stays if it overlaps no base span and none that has stayed.
* The trees are fitted on ``TRAIN_ROWS`` labelled phrases made by rule below, featurized by the same SQL
  expressions; the model has a fixed size.

Offsets are code points, from 0, end exclusive. Replacing matches with marked matches and cutting at the
marks gives the offsets; marks that a text holds itself are first replaced by another private-use
character, which no pattern knows. Spans are run through in order, with a state, in about the square root of their
number of parts (``_scan``); only spans whose overlaps chain are compared with each other. So a text of a hundred
thousand spans is no special case.

Defined cases: a null or empty text has no spans; equal starts are ordered by kind as listed; each row is
judged on its own, so repeated rows and ids do not matter; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, SHUT, OTHER = "\ue000", "\ue001", "\ue002"
TRAIN_ROWS, TREES, RATE, PRECISION = 800, 24, 0.4, 0.97

#: Fixed patterns. Each finds what the plain form in its comment finds.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Quick tests that any match passes.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
GENERATORS = {
    "secret": r"(?i)\b(?>\w*?(?:password|passwd|pwd|secret|token|api[_-]?key))\w*+[\"']?\s?[=:]\s?[\"']?[^\s\"']{6,}+[\"']?",
    "code": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+(?![A-Za-z0-9_-])",
    "number": r"(?<![0-9A-Za-z.+-])(?<![0-9][\x20().-]{1,2})\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])",
    "address": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,}+\s?[\[(]\s?at\s?[\])]\s?[a-z0-9-]{2,}+(?:\s?[\[(]\s?dot\s?[\])]\s?|\.)[a-z]{2,}+",
}
KINDS = [*BASE, *GENERATORS]
_CUE = r"(?i)(?:ssn|social|security|iban|account|phone|tel|mobile|cell|fax|call|passport|licen[cs]e|contact|mail|reach)[\s\w.:#=-]{0,12}$"
_PLAIN = r"(?i)(?:isbn|page|order|invoice|version|item|ref|year|issn|part|no\.?)[\s:#-]{0,3}$"
FEATURES = ["length", "digits", "variety", "upper", "lower", "hex", "separators", "cue", "plain", "luhn", "prefix", "gen"]
#: Characters before a candidate that its features look at.
BEFORE = 24


def _cut(text: Column, pattern: str, need: str | None = None) -> Column:
    """The text cut at the starts of the matches."""
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{SHUT}")), OPEN)
    return F.when(F.contains(text, F.lit(need)), marked).otherwise(F.array(text)) if need else marked


def _scan(items: Column, start: Column, step, kind: str) -> tuple[Column, Column]:
    """Run through an array with a state: (the last state, all that ``step(state, item)`` puts out, as array<kind>).

    ``step`` gives the next state and an array. Items are taken in as many parts as a part has items, so that what
    is put out is copied about the square root of their number of times, not once an item.
    """
    empty = F.array().cast(f"array<{kind}>")
    part = F.ceil(F.sqrt(F.size(items))).cast("int")
    parts = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / part).cast("int") - 1), lambda i: F.slice(items, i * part + 1, part))).otherwise(F.array(items))

    def one(acc: Column, item: Column) -> Column:
        bound = F.transform(F.array(F.struct(*(x.alias(n) for n, x in zip(("state", "out"), step(acc["state"], item), strict=True)))), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))
        return F.get(bound, F.lit(0))

    def several(acc: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(acc["state"].alias("state"), empty.alias("out")), one)
        return F.get(F.transform(F.array(inner), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), F.lit(0))

    done = F.aggregate(parts, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), several, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))
    return done["state"], done["out"]


def _spans(cut: Column, context: bool = False) -> Column:
    """The matches of a cut text; with their ``context`` the last ``BEFORE`` characters before each."""
    last = lambda s: F.substring(s, -BEFORE, BEFORE)

    def step(state: Column, piece: Column) -> tuple[Column, Column]:
        v, pos = F.substring_index(piece, SHUT, 1), state["pos"] if context else state
        span = [pos.alias("start"), (pos + F.length(v)).alias("end"), v.alias("v")]
        pos = pos + F.length(piece) - 1
        if not context:
            return pos, F.array(F.struct(*span))
        # A piece is a match, a mark and what follows.
        return F.struct(pos.alias("pos"), last(F.concat(state["before"], F.translate(piece, SHUT, ""))).alias("before")), F.array(F.struct(*span, state["before"].alias("before")))

    kind = "struct<start:int,end:int,v:string" + (",before:string>" if context else ">")
    first = F.get(cut, F.lit(0))
    start = F.struct(F.length(first).alias("pos"), last(first).alias("before")) if context else F.length(first)
    return F.when(F.size(cut) > 1, _scan(F.slice(cut, F.lit(2), F.size(cut)), start, step, kind)[1]).otherwise(F.array().cast(f"array<{kind}>"))


_CHOICE = "struct<start:int,rank:int,end:int,v:string,odds:double>"


def _apart(spans: Column) -> Column:
    """Of spans ordered by start those that stay: base ones (odds null), and others from the highest odds down that overlap none that stay."""
    meet = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    key = lambda s: F.struct(-F.coalesce(s["odds"], F.lit(math.inf)), s["rank"], s["start"])
    empty = F.array().cast(f"array<{_CHOICE}>")

    def settled(chain: Column) -> Column:
        order = F.array_sort(chain, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
        kept = F.aggregate(order, empty, lambda kept, s: F.when(s["odds"].isNotNull() & F.exists(kept, lambda k: meet(k, s)), kept).otherwise(F.concat(kept, F.array(s))))
        return F.when(F.size(chain) < 2, chain).otherwise(kept)

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        apart = s["start"] >= state["end"]
        chain = F.when(apart, F.array(s)).otherwise(F.concat(state["chain"], F.array(s)))
        return F.struct(F.greatest(state["end"], s["end"]).alias("end"), chain.alias("chain")), F.when(apart, settled(state["chain"])).otherwise(empty)

    state, out = _scan(spans, F.struct(F.lit(0).alias("end"), empty.alias("chain")), step, _CHOICE)
    return F.concat(out, settled(state["chain"]))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    at = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(at(i))).otherwise(at(i)))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _valid(kind: str, span: Column) -> Column:
    v = span["v"]
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(v))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(_digits(v))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _features(v: Column, before: Column, gen: int) -> list[Column]:
    """The features of a candidate, as doubles, in the order of FEATURES."""
    digits = _digits(v)
    core = F.regexp_replace(v, r"^.*[=:]\s?[\"']?|[\"']$", "")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        F.length(v).cast("double"), F.length(digits).cast("double"), F.size(F.array_distinct(F.split(core, ""))).cast("double"),
        flag(core.rlike("[A-Z]")), flag(core.rlike("[a-z]")), flag(core.rlike("^[0-9a-fA-F]+$")),
        F.length(F.regexp_replace(v, r"[^\s().\-]", "")).cast("double"), flag(before.rlike(_CUE)), flag(before.rlike(_PLAIN)),
        flag(F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))), flag(core.rlike("^[A-Z]{4}[A-Z0-9]{12,}$")), F.lit(float(gen)),
    ]


def labelled_phrases(n: int = TRAIN_ROWS, seed: int = 4) -> list[tuple[int, int, str, str]]:
    """Rows (label, generator, words before, candidate) made by rule: half are personal data or secrets."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    num, low, up, hexa = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    word = lambda: pick(low, r.randint(2, 9))
    name = ["secret", "code", "number", "address"].index
    made = [
        lambda: (1, name("secret"), word() + " ", f"{r.choice(['password', 'token', 'secret', 'api_key'])}{r.choice(['=', ' = ', ': '])}{r.choice(['', chr(34)])}{pick(hexa, r.randint(8, 40))}"),
        lambda: (1, name("secret"), word() + " ", f"{r.choice(['Password', 'token'])}={pick(low + up + num + '!#', r.randint(8, 20))}{r.randint(0, 9)}"),
        lambda: (1, name("code"), word() + " ", r.choice(["AKIA", "ASIA"]) + pick(up + num, 16)),
        lambda: (1, name("code"), word() + " ", pick(low + up + num, r.randint(24, 40)) + str(r.randint(0, 9)) + pick(up, 1) + pick(low, 1)),
        lambda: (1, name("number"), r.choice(["ssn ", "SSN: ", "social security "]), f"{pick(num, 3)}-{pick(num, 2)}-{pick(num, 4)}"),
        lambda: (1, name("number"), r.choice(["phone ", "call ", "tel: ", "mobile "]), r.choice([f"({pick(num, 3)}) {pick(num, 3)}-{pick(num, 4)}", f"{pick(num, 3)}-{pick(num, 3)}-{pick(num, 4)}", f"{pick(num, 3)} {pick(num, 3)} {pick(num, 4)}"])),
        lambda: (1, name("address"), r.choice(["contact ", "mail ", word() + " "]), f"{word() * r.choice([1, 1, 2, 8, 30])}{r.choice([' [at] ', ' (at) '])}{word() * r.choice([1, 1, 2, 8, 30])}{r.choice([' [dot] ', '.', ' (dot) '])}com"),
        lambda: (0, name("secret"), word() + " ", f"{r.choice(['token', 'secret', 'password'])}: {pick(low, r.randint(6, 10))}"),
        lambda: (0, name("secret"), word() + " ", f"{r.choice(['token', 'password'])}={'*' * r.randint(6, 10)}"),
        lambda: (0, name("code"), word() + " ", "-".join(word() for _ in range(r.randint(3, 5))) + "-" + word() * 2),
        lambda: (0, name("code"), word() + " ", pick(low, r.randint(16, 30))),
        lambda: (0, name("code"), word() + " ", pick(up, r.randint(16, 24))),
        lambda: (0, name("code"), word() + " ", pick("_-", 1) * r.randint(16, 40)),
        lambda: (0, name("code"), word() + " ", pick(num, r.randint(16, 30))),
        lambda: (0, name("number"), r.choice([word() + " ", "order ", "page ", "isbn ", "ref: "]), r.choice([pick(num, r.randint(7, 13)), f"{pick(num, 3)}-{pick(num, 1)}-{pick(num, 4)}-{pick(num, 4)}-{pick(num, 1)}", f"20{pick(num, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{pick(num, 4)} {pick(num, 4)}"])),
        lambda: (0, name("number"), word() + " ", r.choice([f"{pick(num, 1)}.{pick(num, 3)}.{pick(num, 3)}", f"{pick(num, 2)} {pick(num, 2)} {pick(num, 2)} {pick(num, 2)}", f"{pick(num, 3)} {pick(num, 3)} {pick(num, 4)}"])),
    ]
    return [made[i % len(made)]() for i in range(n)]


class Trees:
    """Gradient boosting with depth-two trees on the logistic loss, for a few hundred rows."""

    def __init__(self):
        self.trees: list[tuple] = []

    @staticmethod
    def _leaf(rows: list[int], g: list[float], h: list[float]) -> float:
        return sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1.0)

    @classmethod
    def _split(cls, x: list[list[float]], rows: list[int], g: list[float], h: list[float]) -> tuple[float, int, float] | None:
        best = None
        for f in range(len(FEATURES)):
            order = sorted(rows, key=lambda i: x[i][f])
            tg, th, lg, lh = sum(g[i] for i in rows), sum(h[i] for i in rows), 0.0, 0.0
            for a, b in zip(order, order[1:], strict=False):
                lg, lh = lg + g[a], lh + h[a]
                if x[a][f] < x[b][f]:
                    gain = lg * lg / (lh + 1.0) + (tg - lg) ** 2 / (th - lh + 1.0)
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, f, (x[a][f] + x[b][f]) / 2
        return best

    def fit(self, x: list[list[float]], y: list[int], trees: int = TREES) -> "Trees":
        score = [0.0] * len(y)
        for _ in range(trees):
            p = [1 / (1 + math.exp(-s)) for s in score]
            g, h = [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]
            every = list(range(len(y)))
            top = self._split(x, every, g, h)
            if top is None:
                break
            parts = [[i for i in every if x[i][top[1]] < top[2]], [i for i in every if x[i][top[1]] >= top[2]]]
            sides = []
            for rows in parts:
                s = self._split(x, rows, g, h)
                if s is None:
                    leaf = RATE * self._leaf(rows, g, h)
                    sides.append((0, -math.inf, leaf, leaf))
                else:
                    low, high = [i for i in rows if x[i][s[1]] < s[2]], [i for i in rows if x[i][s[1]] >= s[2]]
                    sides.append((s[1], s[2], RATE * self._leaf(low, g, h), RATE * self._leaf(high, g, h)))
            self.trees.append((top[1], top[2], *sides))
            score = [s + self._one(self.trees[-1], row) for s, row in zip(score, x, strict=True)]
        return self

    @staticmethod
    def _one(tree: tuple, row: list[float]) -> float:
        f, at, low, high = tree
        g, cut, a, b = low if row[f] < at else high
        return a if row[g] < cut else b

    def probability(self, row: list[float]) -> float:
        return 1 / (1 + math.exp(-sum(self._one(t, row) for t in self.trees)))

    def column(self, feature: Column) -> Column:
        """The log-odds of a struct of features, as nested CASE expressions."""
        get = lambda f: feature[FEATURES[f]]
        leaf = lambda s: F.lit(s[3]) if s[1] == -math.inf else F.when(get(s[0]) < s[1], s[2]).otherwise(s[3])
        total = F.lit(0.0)
        for f, at, low, high in self.trees:
            total = total + F.when(get(f) < at, leaf(low)).otherwise(leaf(high))
        return total


def fitted(spark: SparkSession) -> tuple[Trees, list[float]]:
    """The trees and, for each generator, the log-odds threshold with precision ``PRECISION`` or more."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({i}, {a}, {b}, {quote(c)}, {quote(d)})" for i, (a, b, c, d) in enumerate(labelled_phrases()))
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS t(i, label, gen, before, v)")
    cols = [c.alias(n) for n, c in zip(FEATURES, _features(F.col("v"), F.col("before"), 0), strict=True) if n != "gen"]
    got = sorted(table.select("i", "label", "gen", *cols).collect())
    x = [[float(r["gen"]) if n == "gen" else r[n] for n in FEATURES] for r in got]
    y = [r["label"] for r in got]
    fit = [i for i in range(len(x)) if i // 16 % 2 == 0]
    trees = Trees().fit([x[i] for i in fit], [y[i] for i in fit])
    limits = []
    for g in range(len(GENERATORS)):
        rest = sorted(((trees.probability(x[i]), y[i]) for i in range(len(x)) if i // 16 % 2 and x[i][-1] == g), reverse=True)
        limit, right = 0.999, 0
        for k, (p, label) in enumerate(rest, 1):
            right += label
            if right >= PRECISION * k and p >= 0.5:
                limit = p
        limits.append(math.log(limit / (1 - limit)) - 1e-9)
    return trees, limits


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans: array of (kind, start, end, v, base), ordered by start, then kind as in KINDS."""
    trees, limits = fitted(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    own = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(SHUT))
    df = docs.select("doc_id", "text", F.when(own, F.translate(text, OPEN + SHUT, OTHER * 2)).otherwise(text).alias("__t"))
    cut = {k: _cut(F.col("__t"), p, NEEDS.get(k)) for k, p in BASE.items()}
    gate = {"number": F.col("__t").rlike("[0-9]"), "address": F.lower("__t").rlike(r"[\[(]\s?at")}  # what any match holds
    cut |= {k: F.when(gate.get(k, F.lit(True)), _cut(F.col("__t"), p)).otherwise(F.array("__t")) for k, p in GENERATORS.items()}
    df = df.withColumns({f"__c_{k}": c for k, c in cut.items()})
    df = df.withColumns({f"__s_{k}": _spans(F.col(f"__c_{k}"), k in GENERATORS) for k in KINDS})

    def base(k: str) -> Column:
        kept = F.filter(F.col(f"__s_{k}"), lambda s: _valid(k, s))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), s["end"].alias("end"), s["v"].alias("v"), F.lit(None).cast("double").alias("odds")))

    def proposed(k: str) -> Column:
        g = list(GENERATORS).index(k)

        def judged(s: Column) -> Column:
            feature = F.struct(*(c.alias(n) for n, c in zip(FEATURES, _features(s["v"], s["before"], g), strict=True)))
            return F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), s["end"].alias("end"), s["v"].alias("v"), feature.alias("f"))

        def scored(s: Column) -> Column:
            return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["v"].alias("v"), trees.column(s["f"]).alias("odds"))

        return F.filter(F.transform(F.transform(F.col(f"__s_{k}"), judged), scored), lambda s: s["odds"] >= limits[g])

    df = df.select("doc_id", "text", F.array_sort(F.concat(*map(base, BASE), *map(proposed, GENERATORS))).alias("__found"))
    df = df.select("doc_id", "text", F.when(F.exists("__found", lambda s: s["odds"].isNotNull()), F.array_sort(_apart(F.col("__found")))).otherwise(F.col("__found")).alias("__all"))
    kinds = F.array(*map(F.lit, KINDS))
    out = F.transform("__all", lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["v"].alias("v"), (s["rank"] < len(BASE)).alias("base")))
    return df.select("doc_id", "text", out.alias("spans"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: base counts, digest of the base spans, all spans, n_more and n_spans (added ones, all)."""
    df = spans(docs)
    base = F.filter("spans", lambda s: s["base"])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return df.select("doc_id", *(n(k).alias(f"n_{k}") for k in BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_more"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with each span replaced by its kind in angle brackets; overlapping spans are one."""
    df = spans(docs)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
        mark = F.when(s["start"] >= acc["pos"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.concat(acc["out"], gap, mark).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.length("text"))))
    return df.select("doc_id", F.when(F.size("spans") > 0, done).otherwise(F.col("text")).alias("text"))
