"""Quality rules under weak supervision, in DataFrame functions alone.

Every rule looks at one statistic of a text and votes good, bad or abstains. How far each rule can
be trusted is estimated without labels by expectation-maximisation over the counts of vote
patterns (at most 3 ** rules of them, so the counts are small at any input size), with the class
hidden and rules independent given the class. A text is kept by its posterior probability of being
good and not by passing every rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.plans.session import materialize, unused_name

WORD = "[^\\x20\\x09-\\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5
EM_ROUNDS = 60
#: Votes that a rule is expected to cast on good and on bad texts, before any are counted; they weigh
#: as much as PRIOR_WEIGHT times all texts.
EXPECTED = ({-1: 0.01, 0: 0.09, 1: 0.9}, {-1: 0.4, 0: 0.1, 1: 0.5})
PRIOR_WEIGHT = 0.05


def text_statistics(df: DataFrame, text: str = "text", out: str = "q") -> DataFrame:
    """df with the statistics of its whole texts in a new column `out` (a struct); a null text counts as
    empty. A column of that name is an error, all others stay.

    Repeated words: the words in 3-word windows that occur twice or more. Windows are compared by
    a 64-bit hash of their three words; hashes are sorted with their positions, equal neighbours
    are repeats, and each repeated window adds the words that the one before it didn't cover. That is n log n for a
    text of n words, within its own row and without a shuffle."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists already")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words, n_words, ordered, repeats, lines = (unused_name(df, c) for c in ("_words", "_n", "_w", "_at", "_lines"))
    a = df.withColumn(words, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    a = a.withColumn(n_words, F.size(words))
    windows = F.when(
        F.col(n_words) >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.col(n_words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    a = a.withColumn(ordered, windows)
    size = F.size(ordered)
    repeated = F.filter(
        ordered,
        lambda x, k: (F.get(ordered, k - 1).getField("h") == x.getField("h")) | ((k + 1 < size) & (F.get(ordered, k + 1).getField("h") == x.getField("h"))),
    )
    a = a.withColumn(repeats, F.sort_array(F.transform(repeated, lambda x: x.getField("i"))))
    covered = F.aggregate(
        repeats,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    a = a.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]"))))
    q = F.struct(
        F.col(n_words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(F.split(t, "[#*$%&|<>]+")) - 1).cast("long").alias("n_symbol_runs"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.char_length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.char_length(F.regexp_replace(t, "[^!?]+", "")).cast("long").alias("n_shouts"),
    )
    return a.withColumn(out, q).drop(words, n_words, ordered, repeats, lines)


@dataclass(frozen=True)
class Rule:
    """Votes bad if the ratio is over `bad`, good if at most `good`, else abstains."""

    name: str
    ratio: str
    good: float
    bad: float


#: Symbols are looked at in three ways. These agree more than the model's independence allows, so symbols weigh more than any other
#: statistic; with one of the three alone the estimate takes texts full of symbols for good ones (of labelled junk 47 % is kept at sf0.01
#: instead of under 10 %).
RULES = (
    Rule("symbols", "q.n_symbols / greatest(q.n_words, 1)", 0.05, 0.25),
    Rule("symbol_chars", "q.n_symbols / greatest(q.word_chars, 1)", 0.01, 0.05),
    Rule("symbol_runs", "q.n_symbol_runs / greatest(q.n_words, 1)", 0.05, 0.2),
    Rule("repeats", "q.n_repeat_words / greatest(q.n_words, 1)", 0.15, 0.35),
    Rule("dup_lines", "q.n_dup_lines / greatest(q.n_lines, 1)", 0.1, 0.3),
    Rule("capitals", "q.n_capitals / greatest(q.word_chars, 1)", 0.1, 0.4),
    Rule("shouts", "q.n_shouts / greatest(q.n_words, 1)", 0.1, 0.4),
    Rule("word_length", "abs(q.word_chars / greatest(q.n_words, 1) - 6)", 2.5, 6.0),
)


def vote(rule: Rule) -> Column:
    x = F.expr(rule.ratio)
    return F.when(x > rule.bad, F.lit(-1)).when(x <= rule.good, F.lit(1)).otherwise(F.lit(0))


@dataclass(frozen=True)
class VoteModel:
    """Prior probability of good, and for each rule P(vote | good), P(vote | bad) by vote."""

    prior: float
    tables: tuple[tuple[dict[int, float], dict[int, float]], ...]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.prior / (1 - self.prior)) + sum(math.log(g[v] / b[v]) for v, (g, b) in zip(votes, self.tables, strict=True))

    def posterior(self, columns: list[Column]) -> Column:
        """P(good | votes) as a column expression."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for c, (g, b) in zip(columns, self.tables, strict=True):
            w = {v: math.log(g[v] / b[v]) for v in (-1, 0, 1)}
            total = total + F.when(c < 0, F.lit(w[-1])).when(c > 0, F.lit(w[1])).otherwise(F.lit(w[0]))
        return 1 / (1 + F.exp(-total))


def fit_votes(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = EM_ROUNDS) -> VoteModel:
    """Expectation-maximisation from the counts of vote patterns. It starts from
    texts without any bad vote as probably good; EXPECTED is added to the counts, so no probability
    is 0 and an empty table gives an even prior."""
    share = {p: 0.1 if -1 in p else 0.9 for p in patterns}
    model = VoteModel(0.5, (({-1: 1 / 3, 0: 1 / 3, 1: 1 / 3},) * 2,) * n_rules)
    for _ in range(rounds):
        good = sum(n * share[p] for p, n in patterns.items())
        total = sum(patterns.values())
        tables = []
        for k in range(n_rules):
            cells = []
            for weight, before in zip((lambda p: share[p], lambda p: 1 - share[p]), EXPECTED, strict=True):
                n = {v: (1 + PRIOR_WEIGHT * total) * before[v] for v in (-1, 0, 1)}
                for p, m in patterns.items():
                    n[p[k]] += m * weight(p)
                cells.append({v: x / sum(n.values()) for v, x in n.items()})
            tables.append(tuple(cells))
        model = VoteModel((good + 1) / (total + 2), tuple(tables))
        share = {p: 1 / (1 + math.exp(-max(-700.0, min(700.0, model.log_odds(p))))) for p in patterns}
    return model


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the statistics, base_failed, posterior, kept for every row of docs.

    The statistics of all rows are computed once and written in the shared folder; the model is
    fitted on the vote counts of all of them. Null and empty texts have 0 words and fail; an empty
    table gives no rows; repeated rows are judged alike; other columns are left out. A long text's words and windows are arrays within
    its row, some 60 bytes a word in the JVM."""
    table = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    votes = [vote(r).cast("tinyint").alias(f"v{k}") for k, r in enumerate(RULES)]
    rows = materialize(text_statistics(table).select("key", "q.*", *votes), "quality-rules")
    names = [f"v{k}" for k in range(len(RULES))]
    counted = rows.groupBy(*names).count().collect()  # at most 3 ** len(RULES) rows
    model = fit_votes({tuple(r[n] for n in names): r["count"] for r in counted}, len(RULES))
    posterior = model.posterior([F.col(n) for n in names])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (posterior >= KEEP_AT)).alias("kept"), posterior.alias("posterior"),
    )
