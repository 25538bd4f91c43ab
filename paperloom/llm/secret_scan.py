"""Secret scans: patterns, and character Markov models for what has no pattern.

Two first-order Markov chains over characters are trained from a labelled
sample: one on random strings (keys, digests, encoded bytes), one on ordinary
words and identifiers. A run of key-like characters whose log-likelihood
ratio passes both thresholds is a secret of kind ``markov``. A random string
may also stand inside a path or a joined identifier, whose ordinary parts
outweigh it: of any other run the maximal-scoring segments are tested
(Ruzzo and Tompa), and one that passes is widened to the separators around it.
Pattern spans always stay; what a run has outside them is tested as runs are.

Defined results: a null or empty text has no spans; offsets are code points
with exclusive ends; repeated rows give repeated results; a null key is passed
on; other columns are ignored, or passed on by :func:`redact`.
"""

from __future__ import annotations

import math
import random
import re
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_map import map_batches
from .session import read_table

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# Runs are greedy and maximal, so a least length in the pattern finds the same runs as a later test does.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
SEPARATORS = "/_=-"
ALPHABET = string.ascii_letters + string.digits + "+/_=-"


#: Ordinary words, of which identifiers are joined, and pieces of words in several languages.
WORDS = (
    "access account action address alert allow amount append array async author backup balance base batch block border branch buffer build button byte cache call change channel check child class client close code color column command "
    "common config connect content control copy count create customer data default delete depth device digit display domain double driver element email empty encode entry error event example export extend factory field file filter "
    "first float folder format frame function global group handler hash header height history host image index init insert integer internal item iterator join json key label language layout length level limit link list load local lock "
    "main map message method model module name network next node null number object offset option order output owner package page parent path pattern point policy port prefix price process profile proxy query queue range read record "
    "region request reset result return root route row runtime sample schema score search section select send server service session size sort source split start state status step store string style sum table tag target task test text "
    "thread time token total tree type under unit update user value vector version view weak width window word write year zone"
).split()
SYLLABLES = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce "
    "tion ment able ness ing ly ough ight ence ance eau aux oir elle ement ique ois vous ere sch ung heit keit lich ein ver ber auf zu "
    "cion ado mente ar os as que ez ll rr ga ja do bo mi ta"
).split()
STYLES = ("_".join, "-".join, "/".join, ".".join, "".join, lambda x: "".join(w.capitalize() for w in x), lambda x: x[0] + "".join(w.capitalize() for w in x[1:]), lambda x: "_".join(x).upper())


def labelled_sample(size: int = 4000, seed: int = 7) -> list[tuple[str, bool]]:
    """At most ``size`` strings of each label, the same everywhere; the bound doesn't depend on the corpus."""
    r = random.Random(seed)
    kinds = (string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_lowercase + string.digits)
    out = [("".join(r.choices(kinds[i % len(kinds)], k=r.randint(16, 64))), True) for i in range(size)]
    for i in range(size):
        if i % 40 == 0:  # rules and borders
            out.append((r.choice("/_=-+") * r.randint(8, 60), False))
            continue
        some = r.choices(WORDS if i % 2 else SYLLABLES, k=r.randint(2, 7))
        word = STYLES[i // 2 % len(STYLES)](some) + (str(r.randint(0, 2100)) if r.random() < 0.1 else "")
        out.append((f"__{word}__" if i % 20 == 1 else word, False))
    return out


class MarkovRatio:
    """Log-likelihood ratio of two character chains with add-``k`` smoothing."""

    def __init__(self, sample: list[tuple[str, bool]], k: float = 0.5):
        self.size = len(ALPHABET) + 1
        self.index = {c: i + 1 for i, c in enumerate(ALPHABET)}
        counts = {label: [[k] * self.size for _ in range(self.size)] for label in (True, False)}
        for s, label in sample:
            last = 0
            for c in s:
                now = self.index.get(c, 0)
                counts[label][last][now] += 1
                last = now
        logs = {label: [[math.log(x / sum(row)) for x in row] for row in table] for label, table in counts.items()}
        self.ratio = [[a - b for a, b in zip(x, y, strict=True)] for x, y in zip(logs[True], logs[False], strict=True)]

    def steps(self, s: str) -> list[float]:
        """The ratio of each character after the one before it."""
        codes = [0, *(self.index.get(c, 0) for c in s)]
        return [self.ratio[a][b] for a, b in zip(codes, codes[1:], strict=False)]

    def score(self, s: str) -> float:
        return sum(self.steps(s))


def maximal(x: list[float]) -> list[tuple[int, int]]:
    """(start, end) of all maximal-scoring segments of ``x``, in order; linear time."""
    held: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at end, the last one held whose sum before is less
    total = 0.0
    for i, v in enumerate(x):
        before, total = total, total + v
        if v <= 0:
            continue
        start, low, at = i, before, len(held) - 1
        while True:
            while at >= 0 and held[at][2] >= low:
                at = held[at][4]
            if at < 0 or held[at][3] >= total:
                break
            start, _, low, _, after = held[at]  # the two and all between are one
            del held[at:]
            at = after
        held.append((start, i + 1, low, total, at))
    return [(a, b) for a, b, *_ in held]


class Scanner:
    """``least``: the smallest ratio in nats; ``per_char``: the smallest ratio a character."""

    def __init__(self, sample: list[tuple[str, bool]] | None = None, least: float = 17.0, per_char: float = 0.5):
        self.model = MarkovRatio(labelled_sample() if sample is None else sample)
        self.least, self.per_char = least, per_char

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of the pattern kinds, in order."""
        out = []
        low = text.encode("utf-8", "surrogatepass").lower()
        if any(h in low for h in HINTS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(out)

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(pattern spans, all spans), each in order of start, then kind."""
        base = self.base(text)
        more = []
        first = 0
        for m in RUN.finditer(text):
            s, e = m.span()
            while first < len(base) and base[first][2] <= s:
                first += 1
            at = first
            while s < e:  # what lies before, between and behind pattern spans
                a, _, b = base[at] if at < len(base) else (e, 3, e)
                more += [(x, 3, y) for x, y in self.random_parts(text, s, min(a, e))]
                s, at = max(s, b), at + 1
        return base, sorted(base + more) if more else base

    def passes(self, score: float, n: int) -> bool:
        return score >= self.least and score >= self.per_char * n

    def random_parts(self, text: str, s: int, e: int) -> list[tuple[int, int]]:
        """The spans of text[s:e], which has only key-like characters, that pass; they don't overlap."""
        if e - s < LEAST:
            return []
        steps = self.model.steps(text[s:e])
        if self.passes(sum(steps), e - s):
            return [(s, e)]
        out: list[tuple[int, int]] = []
        # A segment that bridges ordinary parts may have too little a character; what it is made of has not.
        left = [(0, e - s, 0.0)]
        while left:
            a, b, less = left.pop()
            for i, j in maximal([x - less for x in steps[a:b]]):
                i, j = a + i, a + j
                score = sum(steps[i:j])
                if score < self.least:
                    continue
                if less >= self.per_char or self.passes(score, j - i):
                    out.append((i, j))
                else:
                    left.append((i, j, less + self.per_char / 2))
        spans: list[tuple[int, int]] = []
        for i, j in sorted(out):
            while i and text[s + i - 1] not in SEPARATORS:
                i -= 1
            while s + j < e and text[s + j] not in SEPARATORS:
                j += 1
            if spans and i <= spans[-1][1]:
                spans[-1] = spans[-1][0], max(j, spans[-1][1])
            else:
                spans.append((i, j))
        return [(s + i, s + j) for i, j in spans if j - i >= LEAST]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: float = 17.0, per_char: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: key and its spans as an array of structs."""

    def make():
        scanner = Scanner(None, least, per_char)

        def f(b):
            rows = [scanner.scan(t or "") for t in b.column(1).to_pylist()]
            return {
                "key": b.column(0),
                "base_spans": [joined(x) for x, _ in rows],
                "spans": [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in y] for _, y in rows],
            }

        return f

    spec = f"key {docs.schema[key].dataType.simpleString()}, base_spans string, spans array<struct<kind:string,start:int,end:int>>"
    return map_batches(docs.select(key, text), make, spec).withColumnRenamed("key", key)


def redact(docs: DataFrame, *, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mask``; all rows stay."""
    names = docs.columns
    at = names.index(text)

    def make():
        scanner = Scanner()

        def clean(t):
            if not t:
                return t
            _, spans = scanner.scan(t)
            if not spans:
                return t
            out, last = [], 0
            for s, _, e in spans:
                if s >= last:
                    out += [t[last:s], mask]
                last = max(last, e)
            return "".join([*out, t[last:]])

        def f(b):
            return {x: [clean(t) for t in b.column(i).to_pylist()] if i == at else b.column(i) for i, x in enumerate(names)}

        return f

    return map_batches(docs, make, docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find(read_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    each = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return got.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2("base_spans", 256).alias("base_sha256"), F.array_join(each, ",").alias("spans"), n("markov"))
