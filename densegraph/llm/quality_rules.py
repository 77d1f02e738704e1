"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes for or against a document or abstains. Expectation-maximisation over
the counts of vote patterns (at most 3 to the power of the number of rules, however
large the corpus) estimates how often each rule votes which way for good and for bad
documents; the posterior probability of "good" then decides, in place of a filter
that asks all rules to pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densegraph.llm.common import SPACES, let, words_of

#: Frequent function words of the corpus languages.
FUNCTION_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "der", "die", "und", "das", "ist", "ein", "eine", "den", "von", "zu", "le", "la", "les", "de", "et", "des", "un", "une", "que", "en", "el", "los", "las", "del", "y", "se", "por", "con", "para", "es"]

WINDOW = 8


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more in the array, first ones included."""
    # A window's hash joins those of its halves; hashes cut short by the end are dropped.
    pairs = lambda h, by: F.zip_with(h, F.slice(h, by + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))
    window_hashes = lambda w: F.slice(let(let(pairs(w, 1), lambda h: pairs(h, 2)), lambda h: pairs(h, 4)), F.lit(1), F.size(w) - (WINDOW - 1))

    def starts(s: Column) -> Column:
        same = lambda k, by: F.get(s, k + by)["h"] == F.get(s, k)["h"]
        found = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(F.coalesce(same(k, F.lit(-1)), F.lit(False)) | F.coalesce(same(k, F.lit(1)), F.lit(False)), F.get(s, k)["i"]))
        return F.sort_array(F.filter(found, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(p, first, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    def of(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, lambda s: covered(starts(s))))

    return let(words, lambda w: F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(window_hashes(w), of)))


#: Letters and marks that the rules count.
COUNTED = r"[^#*$%&|<>.!?A-ZÄÖÜÉÈÀÇÊÑÓÍ]+"


def statistics(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The input with structs ``_dg_w``, ``_dg_l`` and ``_dg_c`` of the figures that the rules use, and ``_dg_failed``.

    A null or empty text has no words, lines or letters and fails; rows with null ids, repeated rows and all other columns stay; an
    empty table gives no rows. Input columns of these four names are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    count = lambda x, letters: F.length(F.regexp_replace(x, f"[^{letters}]+", "")).cast("long")

    def figures(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_intersect(w, F.array(*map(F.lit, FUNCTION_WORDS)))).alias("function_words"),
        )

    def lines(x: Column) -> Column:
        return F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).alias("lines"))

    def letters(x: Column) -> Column:
        return F.struct(count(x, "#*$%&|<>").alias("n_symbols"), count(x, "!?").alias("marks"), count(x, ".!?").alias("stops"), count(x, "A-ZÄÖÜÉÈÀÇÊÑÓÍ").alias("upper"))

    parts = {"_dg_w": let(words_of(F.col(text_col).cast("string")), figures), "_dg_l": let(filled, lines), "_dg_c": let(F.regexp_replace(text, COUNTED, ""), letters)}
    return docs.withColumns(parts).withColumn("_dg_failed", (F.col("_dg_w.n_words") < 20) | (100 * F.col("_dg_w.n_repeat_words") > 30 * F.col("_dg_w.n_words")))


def votes() -> dict[str, Column]:
    """Each rule's vote on the figures: 1 good, -1 bad, 0 abstains."""
    n = F.greatest(F.col("_dg_w.n_words"), F.lit(1))
    chars = F.greatest(F.col("_dg_w.word_chars"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    share = lambda x, of: F.col(x) / of
    return {
        "length": vote(n >= 50, n < 20),
        "word_length": vote(chars.between(3 * n, 9 * n), (chars < 2 * n) | (chars > 15 * n)),
        "symbols": vote(share("_dg_c.n_symbols", n) < 0.05, share("_dg_c.n_symbols", n) > 0.3),
        "repeats": vote(share("_dg_w.n_repeat_words", n) < 0.1, share("_dg_w.n_repeat_words", n) > 0.3),
        "lines": vote(F.col("_dg_l.n_dup_lines") == 0, 3 * F.col("_dg_l.n_dup_lines") > F.col("_dg_l.lines")),
        "capitals": vote(share("_dg_c.upper", chars) < 0.15, share("_dg_c.upper", chars) > 0.4),
        "marks": vote(share("_dg_c.marks", n) < 0.1, share("_dg_c.marks", n) > 0.5),
        "function_words": vote(F.col("_dg_w.function_words") >= 2, (F.col("_dg_w.function_words") == 0) & (n >= 50)),
        "sentences": vote(share("_dg_c.stops", n).between(0.02, 0.5), (F.col("_dg_c.stops") == 0) & (n >= 50)),
    }


@dataclass
class VoteModel:
    """prior: share of good documents. good, bad: for each rule the chance of each vote (-1, 0, 1) in each class."""

    names: list[str]
    prior: float
    good: list[dict[int, float]]
    bad: list[dict[int, float]]

    def log_odds(self) -> Column:
        rules = votes()
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, g, b in zip(self.names, self.good, self.bad, strict=True):
            w = {v: math.log(g[v] / b[v]) for v in (-1, 0, 1)}
            odds = odds + F.when(rules[name] == 1, w[1]).when(rules[name] == -1, w[-1]).otherwise(w[0])
        return odds


def fit(patterns: dict[tuple[int, ...], int], names: list[str], rounds: int = 50) -> VoteModel:
    """Expectation-maximisation over counted vote patterns; the first guess is that a vote against is right.

    The chances are smoothed by one document a vote, so an empty table gives an undecided model.
    """
    post = {p: 0.05 if min(p) < 0 else 0.95 for p in patterns}
    total = sum(patterns.values())
    k = range(len(names))
    even = [dict.fromkeys((-1, 0, 1), 1 / 3) for _ in k]
    model = VoteModel(names, 0.5, even, even)
    for _ in range(rounds if total else 0):
        weight = {True: 1.0, False: 1.0}
        seen = {c: [dict.fromkeys((-1, 0, 1), 1.0) for _ in k] for c in weight}
        for p, n in patterns.items():
            for c, q in ((True, post[p]), (False, 1 - post[p])):
                weight[c] += n * q
                for j in k:
                    seen[c][j][p[j]] += n * q
        chances = {c: [{v: x / sum(s.values()) for v, x in s.items()} for s in seen[c]] for c in weight}
        model = VoteModel(names, weight[True] / (weight[True] + weight[False]), chances[True], chances[False])
        for p in patterns:
            odds = math.log(model.prior / (1 - model.prior)) + sum(math.log(model.good[j][p[j]] / model.bad[j][p[j]]) for j in k)
            post[p] = 1 / (1 + math.exp(-max(-500, min(500, odds))))
    return model


def learn(figures: DataFrame) -> VoteModel:
    """Fit to the votes over the figures of all documents."""
    rules = votes()
    rows = figures.groupBy(*(v.alias(k) for k, v in rules.items())).count().collect()  # at most 3 ** len(rules) rows
    return fit({tuple(r[k] for k in rules): r["count"] for r in rows}, list(rules))


def verdict(figures: DataFrame, threshold: float = 0.5) -> tuple[Column, Column]:
    """The posterior probability that a document is good, and whether it is kept, as columns over the figures that the model was fitted to."""
    quality = 1 / (1 + F.exp(-learn(figures).log_odds()))
    return quality, ~F.col("_dg_failed") & (quality >= threshold)


def quality_rules(docs: DataFrame, *, threshold: float = 0.5, text_col: str = "text", figures: DataFrame | None = None) -> DataFrame:
    """The input's columns and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept``.

    ``quality`` is the posterior probability that a document is good; ``kept`` is false if
    the base rules failed, else ``quality >= threshold``. A null or empty text has no words
    and fails; null ids stay; repeated rows are judged alike and each counts in the fit; an
    empty table gives no rows. Columns of the input that have the names of results are replaced.
    """
    figures = statistics(docs, text_col=text_col) if figures is None else figures
    quality, kept = verdict(figures, threshold)
    out = {
        "n_words": F.col("_dg_w.n_words"), "word_chars": F.col("_dg_w.word_chars"), "n_symbols": F.col("_dg_c.n_symbols"), "n_dup_lines": F.col("_dg_l.n_dup_lines"),
        "n_repeat_words": F.col("_dg_w.n_repeat_words"), "base_failed": F.col("_dg_failed"), "quality": quality, "kept": kept,
    }
    return figures.withColumns(out).drop("_dg_w", "_dg_l", "_dg_c", "_dg_failed")
