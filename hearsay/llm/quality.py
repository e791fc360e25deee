"""Quality rules as weak supervision.

Each rule votes for a text (1), against it (-1) or abstains (0).  Documents with the
same votes are counted together, and expectation-maximisation over these counts
estimates, without labels, how often every rule votes each way on good and on bad
texts.  A text is kept if its posterior probability to be good reaches the threshold
and it passes the base rules; no single rule decides.

The counts are over all documents and have at most three to the number of rules
rows; each round of the estimation is one aggregate over them.

Defined cases: a null or empty text has no words, fails the base rules and is not
kept; rows with equal ids are judged one by one; an empty table gives an empty
table.  Columns of the input that carry one of the added names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.words import words
from hearsay.session import cut_lineage

SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50        # per cent of the words
ROUNDS = 20
THRESHOLD = 0.5
PRIOR_GOOD = 0.8          # share of good texts before the first round
PRIOR_WEIGHT = 0.05       # weight of the starting rates, as a share of all documents
#: starting rates of a vote against, a vote for and an abstention
START_GOOD = (0.003, 0.80, 0.197)
START_BAD = (0.35, 0.40, 0.25)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*COUNTS, "n_lines", "n_upper", "n_marks", "n_distinct", "n_ended")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts that the rules look at; every one is over the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.drop(*[c for c in MEASURES if c in docs.columns])
    cut = (named.withColumn("_words", words(F.col(text_col)))
           .withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    size = F.size("_words")
    # a window is its 64-bit hash: inside one text of n words two differ in words but not
    # in hash with a chance below n * n / 2 ** 65
    triples = F.when(size >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(size - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.col("_words")[i], F.col("_words")[i + 1],
                                      F.col("_words")[i + 2]).alias("w"), i.alias("i"))))
    sorted_ = (cut.withColumn("_joined", F.array_join("_words", ""))
               .withColumn("_triples", F.sort_array(F.coalesce(triples, F.expr(
                   "cast(array() as array<struct<w:bigint,i:int>>)")))))
    # in sorted order a window that occurs twice has an equal neighbour
    near = lambda t, k: F.coalesce(t["w"] == F.get("_triples", k)["w"], F.lit(False))
    twice = F.filter("_triples", lambda t, k: near(t, k - 1) | near(t, k + 1))
    covered = F.array_distinct(F.flatten(F.transform(
        "_twice", lambda t: F.array(t["i"], t["i"] + 1, t["i"] + 2))))
    without = lambda pattern: F.length("_joined") - F.length(F.regexp_replace("_joined", pattern, ""))
    return (sorted_.withColumn("_twice", twice)
            .withColumn("n_words", size.cast("long"))
            .withColumn("word_chars", F.length("_joined").cast("long"))
            .withColumn("n_symbols", without(SYMBOLS).cast("long"))
            .withColumn("n_lines", F.size("_lines").cast("long"))
            .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
            .withColumn("n_repeat_words", F.size(covered).cast("long"))
            .withColumn("n_upper", without(r"\p{Lu}").cast("long"))
            .withColumn("n_marks", without(r"[!-/:-@\[-`{-~]").cast("long"))
            .withColumn("n_distinct", F.size(F.array_distinct("_words")).cast("long"))
            .withColumn("n_ended", F.size(F.filter("_lines", lambda x: x.rlike(
                r"[.!?][\x20\x09-\x0D]*$"))).cast("long"))
            .select(*named.columns, *MEASURES))


@dataclass(frozen=True)
class Rule:
    """Votes by conditions in SQL over the measures; ``against`` comes first."""
    name: str
    against: str
    favour: str

    def vote(self) -> Column:
        return F.expr(f"case when n_words = 0 then 0 when {self.against} then -1 "
                      f"when {self.favour} then 1 else 0 end")


RULES = (
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words",
         "word_chars between 3 * n_words and 9 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("line_copies", "10 * n_dup_lines > 3 * n_lines", "n_lines >= 2 and 20 * n_dup_lines <= n_lines"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    Rule("capitals", "100 * n_upper > 40 * word_chars", "100 * n_upper <= 15 * word_chars"),
    Rule("length", "n_words < 50", "n_words >= 80"),
    Rule("marks", "100 * n_marks > 12 * word_chars", "100 * n_marks <= 6 * word_chars"),
    Rule("variety", "100 * n_distinct < 12 * n_words", "100 * n_distinct >= 30 * n_words"),
    Rule("line_ends", "10 * n_ended < 3 * n_lines", "10 * n_ended >= 7 * n_lines"),
)


def vote_patterns(voted: DataFrame) -> DataFrame:
    return voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))


def _logit(votes: Column, model: Column) -> Column:
    """Log odds of a good text given its votes; rates are [rule][vote + 1]."""
    ratios = F.transform(votes, lambda v, j: F.log(
        F.element_at(model["good"][j], v + 2) / F.element_at(model["bad"][j], v + 2)))
    return F.log(model["share"] / (1 - model["share"])) + _sum(ratios)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def posterior(votes: Column, model: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_logit(votes, model)))


def _rates(start: tuple[float, float, float], n_rules: int) -> Column:
    against, favour, none = start
    return F.array(*[F.array(F.lit(against), F.lit(none), F.lit(favour)) for _ in range(n_rules)])


def estimate(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row with ``rows`` and ``model``: good rates, bad rates and share of good texts.

    ``patterns`` (votes, n) is at most 3 ** n_rules rows, whatever the corpus, so the
    rounds run over one array; without rows the starting values stay.
    """
    start_good, start_bad = _rates(START_GOOD, n_rules), _rates(START_BAD, n_rules)
    model = F.struct(start_good.alias("good"), start_bad.alias("bad"),
                     F.lit(PRIOR_GOOD).alias("share"))
    table = patterns.agg(
        F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"))

    def round_(m: Column, _: Column) -> Column:
        weighed = F.transform("rows", lambda r: F.struct(
            r["votes"].alias("votes"), r["n"].alias("n"),
            (r["n"] * posterior(r["votes"], m)).alias("g")))
        return F.transform(F.array(weighed), step)[0]

    def step(seen: Column) -> Column:
        weight = F.col("total") * PRIOR_WEIGHT
        good_n = _sum(F.transform(seen, lambda r: r["g"]))

        def table_of(start: tuple, part, mass: Column) -> Column:
            against, favour, none = start
            prior = F.array(F.lit(against), F.lit(none), F.lit(favour))
            return F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), lambda j: F.transform(
                prior, lambda p, k: (_sum(F.transform(seen, lambda r: F.when(
                    r["votes"][j] + 1 == k, part(r)).otherwise(0.0))) + weight * p) / (mass + weight)))

        return F.struct(
            table_of(START_GOOD, lambda r: r["g"], good_n).alias("good"),
            table_of(START_BAD, lambda r: r["n"] - r["g"], F.col("total") - good_n).alias("bad"),
            ((good_n + weight * PRIOR_GOOD) / (F.col("total") + weight)).alias("share"))

    learned = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), model, round_)
    return table.withColumn("model", F.when(F.col("total") > 0, learned).otherwise(model))


def pattern_quality(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """``(votes, quality)``: the posterior of every vote pattern under the estimated model."""
    # the model is bound to a name first, or it would be estimated once per pattern
    scored = F.transform(F.array("model"), lambda m: F.transform("rows", lambda r: F.struct(
        r["votes"].alias("votes"), posterior(r["votes"], m).alias("quality"))))[0]
    return estimate(patterns, n_rules, rounds).select(F.inline(scored))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD,
          rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, counts, base_failed, kept, quality, votes)`` for every row.

    The measured table (numbers only) is written once: the counts of vote patterns and
    the result both read it.
    """
    measured = measures(docs.select(id_col, text_col), text_col)
    voted = cut_lineage(measured.select(
        id_col, *COUNTS, F.array(*[r.vote() for r in rules]).alias("votes")))
    patterns = cut_lineage(vote_patterns(voted))
    scored = cut_lineage(pattern_quality(patterns, len(rules), rounds))
    failed = ((F.col("n_words") < LEAST_WORDS)
              | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return (voted.join(scored, "votes").withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
            .select(id_col, *COUNTS, "base_failed", "kept", "quality", "votes"))
