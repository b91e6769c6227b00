"""Personal data: candidate spans, scored by gradient-boosted trees, with DataFrame functions only.

Generators of high recall propose spans of several kinds that may overlap: whatever looks like a secret, an address spelled out, an identity or
account number or a local phone number. Boosted trees, trained on the driver from
generated examples and turned into CASE expressions, score every candidate of these additional kinds
by its format and its context; thresholds calibrated on examples of other names, formats and words than those trained on select. Spans of the four
base kinds that pass their own check always stay, and additional spans never overlap them. Of additional spans that overlap one
another, the one of higher score stays (then the one that starts first, then that of the kind listed first).

Starts and ends count code points, ends are exclusive. Positions come from one pass that sets a
mark around every match and splits there, added up in chunks, so that the work grows with the number of matches; a text that holds the mark itself is searched with
another character in its place.

Defined results: null and empty texts have no spans; texts are searched whole, however long; repeated rows give repeated rows; an empty
table gives no rows; `redact` keeps every column, whatever its name, and null texts as they are.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import lru_cache
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\u0001"
BASE = ["email", "ip", "card", "phone"]
MORE = ["secret", "spelled", "number", "local"]

#: Patterns find the same leftmost matches as the plain forms in the comments, in linear time: no
#: match can start inside a run whose first character starts none, and what follows a run can't
#: match its characters.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # a name and a value, or a run of 16 characters and more with a digit in it
    "secret": r"(?i)(?<![a-z0-9_])(?:password|passwd|pwd|token|secret|api[_-]?key|bearer)(?:\x20{0,2}[=:]\x20{0,2}|\x20)[\"']?[A-Za-z0-9+/_.-]{6,}+[\"']?|(?<![a-z0-9_-])(?=[a-z_-]*+[0-9])[a-z0-9_-]{16,}+",
    "spelled": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,40}\x20?[\[(]?\x20?at\x20?[\])]?\x20?[a-z0-9-]{2,40}\x20?[\[(]?\x20?dot\x20?[\])]?\x20?[a-z]{2,6}(?![a-z])",
    "number": r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9-])|(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "local": r"(?<![0-9+().-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9.-])",
}
#: What a text must contain before a pattern is tried.
NEEDS = {"email": "@", "phone": "+", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "secret": r"(?i)passw|pwd|token|secret|api|bearer|[a-z0-9_-]{16}", "spelled": r"(?i)dot", "number": r"[0-9]{2}", "local": r"[0-9]{3}"}
#: Pieces of a text whose positions are added up at once; an even number, so that chunks start outside a match.
CHUNK = 256
KEYWORDS = r"(?i)phone|tel|call|fax|ssn|social|iban|account|mail|contact|reach|write"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    parts = F.transform(reverse, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        # leading zeros don't count; four digits are too many whatever they are
        size = lambda p: F.concat(F.lit("0"), F.substring(F.regexp_replace(p, "^0+", ""), 1, 4)).cast("int")
        return F.forall(F.split(x, r"\."), lambda p: size(p) <= 255)
    if kind == "card":
        n = F.length(_digits(x))
        return F.when((n >= 16) & (n <= 19), luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(x))
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """array<struct<s, e, x>> of the non-overlapping matches of a kind, by start."""
    need = NEEDS[kind]
    guard = F.contains(text, F.lit(need)) if len(need) == 1 else text.rlike(need)
    pieces = F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK)
    kind_of = "array<struct<s:int,e:int,x:string>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(kind_of).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        found = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), end.alias("e"), x.alias("x"))))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], found).otherwise(acc["out"]).alias("out"))

    def placed(acc: Column, c: Column) -> Column:
        own = F.transform(c["out"], lambda m: F.struct((m["s"] + acc["at"]).alias("s"), (m["e"] + acc["at"]).alias("e"), m["x"].alias("x")))
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["lists"], F.array(own)).alias("lists"))

    def in_chunks(p: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda i: F.aggregate(F.slice(p, i * CHUNK + 1, F.lit(CHUNK)), start, step))
        return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind_of}>").alias("lists")), placed, lambda acc: F.flatten(acc["lists"]))

    # the pieces are made once, as the variable of a one-element array
    return F.when(guard, F.transform(F.array(pieces), in_chunks)[0]).otherwise(F.array().cast(kind_of))


# --- boosted trees -------------------------------------------------------------------------------

FEATURES = ["length", "digits", "letters", "capitals", "quoted", "assigned", "bracketed", "keyword", "spaces", "mixed", "letter_before", "share", "kind"]


def _facts(text: str, s: int, e: int, kind: str) -> list[float]:
    """The features of a candidate, in Python, for the generated examples."""
    import re

    x, before = text[s:e], text[max(0, s - 24) : s]
    tail = re.sub(r"^.*[=:]", "", x)
    return [
        len(x),
        sum(c in "0123456789" for c in x),
        sum(c.isascii() and c.isalpha() for c in x),
        sum("A" <= c <= "Z" for c in x),
        float('"' in x or "'" in x),
        float("=" in x or ":" in x),
        float("[" in x or "(" in x),
        float(bool(re.search(KEYWORDS, before))),
        x.count(" "),
        float(bool(re.search("[0-9]", tail)) and bool(re.search("[A-Za-z]", tail))),
        float(bool(re.search(r"[A-Za-z]\x20?$", before))),
        sum(c in "0123456789" for c in tail) / max(1, len(tail)),
        float(MORE.index(kind)),
    ]


def _fact_columns(text: Column, c: Column, kind: str) -> list[Column]:
    """The same features as columns; c has s, e and x."""
    x = c["x"]
    start = F.greatest(c["s"] - 23, F.lit(1))
    before = F.substr(text, start, c["s"] - start + 1)
    tail = F.regexp_replace(x, "^.*[=:]", "")
    n = lambda pattern: F.regexp_count(x, F.lit(pattern)).cast("double")
    flag = lambda b: F.when(b, 1.0).otherwise(0.0)
    return [
        F.length(x).cast("double"),
        n("[0-9]"),
        n("[A-Za-z]"),
        n("[A-Z]"),
        flag(x.rlike("[\"']")),
        flag(x.rlike("[=:]")),
        flag(x.rlike(r"[\[(]")),
        flag(before.rlike(KEYWORDS)),
        n(r"\x20"),
        flag(tail.rlike("[0-9]") & tail.rlike("[A-Za-z]")),
        flag(before.rlike(r"[A-Za-z]\x20?$")),
        F.regexp_count(tail, F.lit("[0-9]")) / F.greatest(F.lit(1), F.length(tail)),
        F.lit(float(MORE.index(kind))),
    ]


def examples(n: int, seed: int, other: bool = False) -> list[tuple[list[float], int]]:
    """Generated candidates with their labels: real formats, and ordinary text that only looks like one.

    `other` takes names, formats, cues and letters that the rest never has: for calibration and tests.
    """
    r = random.Random(seed)
    letters = "bdefgijkmnopqrtuvwz" if other else "abcdefghilmnoprstuw"
    word = lambda a=2, b=9: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    of = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    num, hexes, upper = (lambda k: of("0123456789", k, k)), (lambda a, b: of("0123456789abcdef", a, b)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = lambda a, b: of("abcdefghijklmnopqrstuvwxyz" + upper, a, b) + num(1)
    cues = ["ring ", "mobile contact ", "write to ", "fax: ", "iban "] if other else ["phone ", "tel. ", "call ", "contact: ", "mail ", "account "]
    out = []
    for _ in range(n):
        kind, good = r.choice(MORE), r.random() < 0.5
        lead = " ".join(word() for _ in range(r.randint(1, 5))) + r.choice([" ", ", ", ". "])
        cue = r.choice(cues) if r.random() < (0.6 if good else 0.1) else ""
        if kind == "secret":
            name = r.choice(["pwd", "secret", "passwd", "api-key", "bearer"] if other else ["password", "token", "api_key", "apikey", "pwd"])
            q, sign = r.choice(["", '"', "'"]), r.choice([":", " =", " : "] if other else ["=", " = ", ": "])
            if good:
                bare = [f"{hexes(8, 8)}-{hexes(4, 4)}-4{hexes(3, 3)}-{hexes(4, 4)}-{hexes(12, 12)}", "xo" + of("xbp", 2, 2) + "-" + num(10) + "-" + mixed(10, 24), of(upper, 20, 32) + num(2)] if other else [hexes(24, 64) + "0", "AK" + of(upper, 16, 20) + num(1), "gh_" + mixed(24, 36), mixed(20, 40)]
                x = r.choice([f"{name}{sign}{q}{hexes(8, 48)}{q}", f"{name}{sign}{q}{mixed(8, 30)}{q}", f"{name}{sign}{q}{word(5, 9)}{num(3)}{q}", *bare])
            else:
                long = ["chapter_" + num(2) + "_verse_" + num(1) + "_line", word(6, 9) + "-" + num(1) + "-" + word(8, 12), num(r.randint(16, 24))] if other else ["section-" + num(2) + "-of-the-" + word(), num(4) + "-" + num(2) + "-" + num(2) + "-report-" + word(), word(16, 20) + num(1), num(r.randint(16, 20))]
                x = r.choice([f"{name}{r.choice([': ', ' '])}{word(6, 9)}", f"{name} {word(6, 9)}", *long])
        elif kind == "spelled":
            dots = [" dot ", "(dot)"] if other else [" (dot) ", " [dot] "]
            x = f"{word()}{r.choice(['.', '', '_'])}{word()}{r.choice([' [at] ', '(at)'] if other else [' (at) ', ' [at] ', ' at '])}{word()}{r.choice(dots)}{r.choice(['com', 'org', 'net', 'de'])}" if good else f"{word()} at {word()} dot {r.choice(['on', 'by', 'for'] if other else ['the', 'and', 'to', 'in'])}"
        elif kind == "number":
            iban = "ES" + num(22) if other else r.choice(["DE" + num(20), "FR" + num(2) + " " + " ".join(num(4) for _ in range(5))])
            x = r.choice([f"{num(3)}-{num(2)}-{num(4)}", iban]) if good else r.choice(["IS" + num(2) + " WHAT THEY SAID"] if other else ["AB" + num(2) + " ABCD WORD THEN", "NO" + num(2) + " THIS THAT HAVE"])
        else:
            formats = [f"{num(3)}.{num(3)}.{num(4)}", f"({num(3)}) {num(3)} {num(4)}"] if other else [f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"({num(3)}) {num(3)} {num(4)}"]
            wrong = [f"{num(4)} {num(3)} {num(3)}", f"{num(2)}/{num(4)}/{num(4)}"] if other else [f"{num(3)} {num(3)} {num(4)}", f"{num(2)}/{num(3)}/{num(4)}", f"{num(4)} {num(4)} {num(4)}"]
            x = r.choice(formats if good else wrong)
        text = lead + cue + x
        out.append((_facts(text, len(text) - len(x), len(text), kind), int(good)))
    return out


def _grow(rows: list[tuple[list[float], float, float]], depth: int, rate: float) -> tuple | float:
    """A regression tree on gradients and curvatures: (feature, threshold, left if <=, right) or a leaf's value."""
    g, h = sum(x[1] for x in rows), sum(x[2] for x in rows)
    leaf = rate * g / (h + 1.0)
    if not depth or len(rows) < 12:
        return leaf
    best = (1e-6, -1, 0.0)
    for f in range(len(FEATURES)):
        order = sorted(rows, key=lambda x: x[0][f])
        lg = lh = 0.0
        for a, b in pairwise(order):
            lg += a[1]
            lh += a[2]
            if a[0][f] != b[0][f]:
                gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, f, (a[0][f] + b[0][f]) / 2)
    _, f, at = best
    if f < 0:
        return leaf
    return f, at, _grow([x for x in rows if x[0][f] <= at], depth - 1, rate), _grow([x for x in rows if x[0][f] > at], depth - 1, rate)


def _walk(tree: tuple | float, facts: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if facts[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(maxsize=2)
def boosted(n: int = 1200, rounds: int = 20, depth: int = 4, rate: float = 0.4, precision: float = 0.98) -> tuple[list, dict[str, float]]:
    """Trees, and for each kind the lowest score at which examples of other names and formats reach the precision."""
    train, held = examples(n, 1), examples(n, 2, other=True)
    score = [0.0] * n
    trees = []
    for _ in range(rounds):
        rows = []
        for (facts, label), s in zip(train, score, strict=True):
            p = 1 / (1 + math.exp(-s))
            rows.append((facts, label - p, max(1e-6, p * (1 - p))))
        trees.append(_grow(rows, depth, rate))
        score = [s + _walk(trees[-1], facts) for s, (facts, _) in zip(score, train, strict=True)]
    thresholds = {}
    for k, kind in enumerate(MORE):
        found = sorted(((sum(_walk(t, f) for t in trees), label) for f, label in held if f[-1] == k), reverse=True)
        thresholds[kind], good = math.inf, 0
        for i, (s, label) in enumerate(found, 1):
            good += label
            if good >= precision * i and s > 0:
                thresholds[kind] = s
    return trees, thresholds


def _tree_column(tree: tuple | float, facts: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(facts[tree[0]] <= tree[1], _tree_column(tree[2], facts)).otherwise(_tree_column(tree[3], facts))


# --- the operator --------------------------------------------------------------------------------


def _of(check: Callable[[str, Column], Column], kind: str) -> Callable[[Column], Column]:
    return lambda c: check(kind, c["x"])


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda c: c["kind"] == kind


def _span(kind: str) -> Callable[[Column], Column]:
    return lambda c: F.struct(F.lit(kind).alias("kind"), c["s"].alias("s"), c["e"].alias("e"))


def _described(text: Column, kind: str) -> Callable[[Column], Column]:
    return lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.array(*_fact_columns(text, c, kind)).alias("f"))


def _scored(trees: list) -> Callable[[Column], Column]:
    return lambda c: F.struct(sum((_tree_column(t, c["f"]) for t in trees), F.lit(0.0)).alias("score"), c["s"].alias("s"), c["e"].alias("e"))


def _chosen(kind: str, threshold: float) -> Callable[[Column], Column]:
    return lambda c: F.when(c["score"] >= threshold, F.struct((-c["score"]).alias("score"), c["s"].alias("s"), F.lit(MORE.index(kind)).alias("order"), c["e"].alias("e"), F.lit(kind).alias("kind")))


def with_spans(docs: DataFrame, column: str = "text") -> DataFrame:
    """`docs` with `_p_spans`: array<struct<kind, s, e>> by kind as listed, then start; base kinds first."""
    trees, thresholds = boosted()
    t = F.coalesce(F.col(column).cast("string"), F.lit(""))
    out = docs.withColumn("_p_text", F.when(F.contains(t, F.lit(MARK)), F.translate(t, MARK, "\u0002")).otherwise(t))
    text = F.col("_p_text")
    own = F.concat(*[F.transform(F.filter(matches(text, k), _of(_valid, k)), _span(k)) for k in BASE])
    extra = []
    for k in MORE:
        scored = F.transform(F.transform(matches(text, k), _described(text, k)), _scored(trees))
        extra.append(F.filter(F.transform(scored, _chosen(k, min(thresholds[k], 1e9))), lambda c: c.isNotNull()))
    out = out.withColumn("_p_base", own).withColumn("_p_more", F.concat(*extra))
    over = lambda b, c: (b["s"] < c["e"]) & (c["s"] < b["e"])
    free = F.filter("_p_more", lambda c: ~F.exists("_p_base", lambda b: over(b, c)))
    # the highest score first; what overlaps one that stays goes
    best = F.aggregate(F.sort_array(free), F.slice("_p_more", 1, 0), lambda acc, c: F.when(F.exists(acc, lambda b: over(b, c)), acc).otherwise(F.concat(acc, F.array(c))))
    listed = F.sort_array(F.transform(best, lambda c: F.struct(c["order"].alias("order"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    some = F.transform(listed, lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    return out.withColumn("_p_spans", F.concat(F.col("_p_base"), some))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    out = with_spans(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("_p_base", _is(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("_p_base")), 256).alias("base_sha256"), _listed(F.col("_p_spans")).alias("spans"))


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """`docs` with every span of the text column replaced by its kind in angle brackets; overlapping spans count as one."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = with_spans(docs.select(F.struct(*columns).alias("_p_row"), F.col(column).cast("string").alias("_p_own")), "_p_own")
    order = F.sort_array(F.transform("_p_spans", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))

    def join(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], c["e"]).alias("e"), last["kind"].alias("kind"))
        apart = (F.size(acc) == 0) | (F.get(acc, F.size(acc) - 1)["e"] <= c["s"])
        return F.when(apart, F.concat(acc, F.array(c))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown)))

    out = out.withColumn("_p_order", order)
    out = out.withColumn("_p_cuts", F.aggregate("_p_order", F.slice("_p_order", 1, 0), join))
    cuts, text = F.col("_p_cuts"), F.col("_p_own")
    lead = F.transform(cuts, lambda c, i: F.concat(F.substr(text, F.coalesce(F.get(cuts, i - 1)["e"], F.lit(0)) + 1, c["s"] - F.coalesce(F.get(cuts, i - 1)["e"], F.lit(0))), F.lit("<"), c["kind"], F.lit(">")))
    rest = F.substr(text, F.element_at(cuts, -1)["e"] + 1, F.length(text))
    changed = F.when(F.size(cuts) > 0, F.concat(F.array_join(lead, ""), rest)).otherwise(text)
    return out.select(*[(changed if c == column else F.col(f"_p_row.`{c}`")).alias(c) for c in docs.columns])
