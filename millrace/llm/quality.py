"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good or bad or abstains on counts of a whole text; no rule is a combination of
others, and several look at the same thing from different sides. Expectation-maximisation over the
counts of vote patterns (at most 3 ** rules of them, whatever the number of documents) estimates,
without labels, how often each rule votes bad, abstains and votes good on good and on bad documents, and the
share of good ones. It starts from the share of good among each document's votes; the only
prior is `PRIOR`, which counts as ten documents. The posterior probability of quality decides: a rule
that often misfires loses its weight, and a few bad votes that rarely come alone can outweigh many
good ones. A document that fails the base rule is rejected in any case.

Defined results: null and empty texts have no words and fail the base rule; texts are counted whole, however long;
documents with equal votes get equal verdicts; repeated rows give repeated rows; on an empty table nothing is estimated and nothing returned; `keep` passes
all columns on, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._store import spill

SPACE = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
THRESHOLD = 0.5
ROUNDS = 500
#: Votes (bad, abstained, good) that a rule is taken to have cast on bad and on good documents before any is seen.
PRIOR = ((4.0, 2.0, 4.0), (1.0, 1.0, 8.0))

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = """
    the of and to a in is it for on with as was by that this be are from at or an
    der die das und zu den von mit auf für ist im dem ein eine des sich nicht
    de la le les et en un une du que dans par pour sur au el los las y del con se por para lo al
""".split()

#: name, then the SQL conditions under which the rule votes bad and good; it abstains where neither holds.
RULES = [
    ("length", "n_words < 50", "n_words >= 100"),
    ("repetition", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("letters", "100 * n_letters < 85 * word_chars", "100 * n_letters >= 93 * word_chars"),
    ("capitals", "10 * n_upper > 3 * n_letters", "10 * n_upper <= n_letters"),
    ("exclamation", "10 * n_exclaim > n_words", "100 * n_exclaim <= 2 * n_words"),
    ("function_words", "100 * n_function < 8 * n_words", "100 * n_function >= 15 * n_words"),
    ("word_length", "10 * word_chars > 65 * n_words or word_chars < 3 * n_words", "10 * word_chars <= 60 * n_words and word_chars >= 4 * n_words"),
    ("distinct", "100 * n_distinct < 60 * n_words", "100 * n_distinct >= 70 * n_words"),
    ("sentences", "100 * n_sentences < 4 * n_words or 100 * n_sentences > 20 * n_words", "100 * n_sentences >= 6 * n_words and 100 * n_sentences <= 15 * n_words"),
]


def measured(docs: DataFrame, column: str = "text") -> tuple[DataFrame, list[str]]:
    """`docs` with the counts of each text, under names that start with `_q_`."""
    t = F.coalesce(F.col(column).cast("string"), F.lit(""))
    out = docs.withColumn("_q_words", F.array_remove(F.split(t, SPACE), ""))
    words = F.col("_q_words")
    grams = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    out = out.withColumn("_q_n", F.size(words)).withColumn("_q_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(SOLID)))
    # windows of three words, sorted by hash: those beside an equal one are repeated
    out = out.withColumn("_q_sorted", F.sort_array(F.when(F.col("_q_n") >= 3, F.slice(grams, F.lit(1), F.col("_q_n") - 2)).otherwise(F.slice(grams, 1, 0))))
    grams = F.col("_q_sorted")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(grams, lambda x, k: same(x, F.get(grams, k - 1)) | same(x, F.get(grams, k + 1))), lambda x: x["i"]))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    repeated = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    counts = {
        "n_words": F.col("_q_n"),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, "")),
        "n_lines": F.size("_q_lines"),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": repeated,
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", "")),
        "n_exclaim": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
        "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
        "n_function": F.size(F.filter(words, lambda w: F.lower(w).isin(FUNCTION_WORDS))),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_sentences": F.regexp_count(t, F.lit(rf"[.?!](?!{SOLID})")),
    }
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.cast("bigint").alias(f"_q_{name}") for name, c in counts.items()])
    return out, list(counts)


def _vote(bad: str, good: str, names: list[str]) -> Column:
    bad, good = (re.sub("|".join(rf"\b{x}\b" for x in names), lambda m: f"_q_{m[0]}", s) for s in (bad, good))
    return F.expr(f"case when {bad} then 0 when {good} then 1 end")


Rates = list[tuple[tuple[float, ...], tuple[float, ...]]]
Pattern = tuple[int | None, ...]


def estimate(patterns: list[tuple[Pattern, int]], rounds: int = ROUNDS) -> tuple[float, Rates]:
    """Share of good documents, and each rule's rates of voting bad, abstaining and voting good on bad and on good documents.

    patterns: votes of all rules (1 good, 0 bad, None abstains), and how many documents have them.
    """
    total = sum(n for _, n in patterns)
    places = [[1 if v is None else 2 * v for v in votes] for votes, _ in patterns]
    now = [(p.count(2) + 1) / (p.count(2) + p.count(0) + 2) for p in places]
    share, rates = 0.5, [PRIOR] * len(RULES)
    for _ in range(rounds):
        share = (sum(n * p for (_, n), p in zip(patterns, now, strict=True)) + 1) / (total + 2)
        sums = [[list(side) for side in PRIOR] for _ in RULES]
        for (_, n), place, p in zip(patterns, places, now, strict=True):
            for s, k in zip(sums, place, strict=True):
                s[0][k] += n * (1 - p)
                s[1][k] += n * p
        rates = [tuple(tuple(x / sum(side) for x in side) for side in s) for s in sums]
        was, now = now, [posterior(votes, share, rates) for votes, _ in patterns]
        if all(abs(a - b) < 1e-9 for a, b in zip(was, now, strict=True)):
            break
    return share, rates


def posterior(votes: Pattern, prior: float, rates: Rates) -> float:
    """Probability of quality, given the votes."""
    logit = math.log(prior / (1 - prior)) + sum(_weights(r)[1 if v is None else 2 * v] for v, r in zip(votes, rates, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def _weights(rates: tuple[tuple[float, ...], tuple[float, ...]]) -> list[float]:
    return [math.log(g / b) for b, g in zip(*rates, strict=True)]


def scored(docs: DataFrame, column: str = "text") -> DataFrame:
    """`docs` with its counts (`_q_..`), `_q_failed`, `_q_quality` (posterior) and `_q_kept`.

    The counts are written as a table once; estimation and decision read it.
    """
    counted, names = measured(docs, column)
    votes = [_vote(bad, good, names).alias(f"_q_vote_{rule}") for rule, bad, good in RULES]
    table, _ = spill(counted.select("*", *votes), "quality")
    columns = [f"_q_vote_{rule}" for rule, _, _ in RULES]
    rows = table.groupBy(*columns).count().collect()  # at most 3 ** len(RULES)
    patterns = sorted(((tuple(r[c] for c in columns), r["count"]) for r in rows), key=str)
    prior, rates = estimate(patterns)
    logit = F.lit(math.log(prior / (1 - prior)))
    for c, r in zip(columns, rates, strict=True):
        bad, none, good = _weights(r)
        logit = logit + F.when(F.col(c) == 1, good).when(F.col(c) == 0, bad).otherwise(none)
    failed = (F.col("_q_n_words") < 50) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))
    out = table.withColumn("_q_failed", failed).withColumn("_q_quality", 1 / (1 + F.exp(-logit)))
    return out.withColumn("_q_kept", ~F.col("_q_failed") & (F.col("_q_quality") >= THRESHOLD))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality."""
    out = scored(docs.select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in counts], F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.col("_q_quality").alias("quality"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are not rejected, as they are."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return scored(packed, "row.text").filter("_q_kept").select("row.*")
