"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes keep, votes reject or abstains. Rules that look at the same trait form a group, which has one
vote: reject if one of them rejects, else keep if one keeps; so votes of different groups are nearly
independent within a class. Expectation-maximisation over the table of vote patterns (at most 3 ** groups
rows, whatever the input's size) estimates how often each group gives each vote on good and on bad
documents; the posterior probability that a document is good replaces the requirement that all rules pass. The
fit is an ``aggregate`` fold over a one-row table, so nothing is collected to the driver and no Python runs on
executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import settle

BLANK = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
#: P(reject | a vote) expected of a group on bad and on good documents, and how many votes in each class that belief counts as.
EXPECTED = {"bad": 0.4, "good": 0.01}
BELIEF = 2.0
#: The most of the bad documents that one group is taken to see: they come in kinds, so a group's keep says little of other kinds.
MOST_FOUND = 0.5
#: The fit ends when no posterior moves by this much, after so many rounds at most.
CLOSE, ROUNDS = 1e-9, 1000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """Votes by an SQL expression over the counts: reject where ``value`` >= ``reject``, keep where it is <= ``keep``; abstains else, and below ``least`` words.

    ``odds`` is what is assumed of it: its reject is at least so many times likelier on a bad document than on a good one."""

    name: str
    group: str
    value: str
    reject: float | None = None
    keep: float | None = None
    least: int = 0
    odds: float = 50.0


def share(part: str, whole: str = "n_words") -> str:
    return f"try_divide({part}, {whole})"


def default_rules() -> list[Rule]:
    return [
        Rule("symbols", "symbols", share("n_symbols"), reject=0.2, keep=0.05),
        Rule("dup_lines", "repetition", share("n_dup_lines", "n_lines"), reject=0.4, least=150),
        Rule("repeat_words", "repetition", share("n_repeat_words"), reject=0.3, keep=0.1),
        Rule("runs", "repetition", share("n_runs"), reject=0.3),
        Rule("capitals", "capitals", share("n_upper", "n_letters"), reject=0.4, keep=0.15),
        Rule("shouts", "capitals", share("n_shouts"), reject=0.2),
        Rule("few_words", "variety", f"1 - {share('n_distinct')}", reject=0.9, keep=0.6, least=50),
        Rule("word_length", "word_length", share("word_chars"), reject=25.0, keep=12.0),
    ]


def groups_of(rules: Sequence[Rule]) -> list[str]:
    """The groups, in the order in which rules name them."""
    return list(dict.fromkeys(r.group for r in rules))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once: an expression inside a lambda is otherwise evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside a window of ``WINDOW`` words that occurs at least twice. Windows compare by a 64-bit hash."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
            return F.filter(F.transform(s, lambda x, k: F.when(same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x), x["i"])), lambda p: p.isNotNull())

        fold = F.aggregate(
            F.sort_array(let(pairs, positions)),
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).cast("long").alias("n")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(fold)

    def windows(w: Column) -> Column:
        at = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered)


def rule_features(docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """``carry`` columns of ``docs`` and the counts the rules read; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    held = docs.select(*carry, text.alias("__text"), words.alias("__words"), lines.alias("__lines"))
    w, t = F.col("__words"), F.col("__text")
    count = lambda c: c.cast("long")
    left = lambda pattern: count(F.length(F.regexp_replace(t, pattern, "")))
    return held.select(
        *carry,
        count(F.size(w)).alias("n_words"),
        count(F.length(F.array_join(w, ""))).alias("word_chars"),
        left("[^#*$%&|<>]+").alias("n_symbols"),
        count(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        count(F.size("__lines")).alias("n_lines"),
        left("\\P{Lu}+").alias("n_upper"),
        left("\\P{L}+").alias("n_letters"),
        count(F.size(F.filter(w, lambda x: x.endswith("!!")))).alias("n_shouts"),
        count(F.aggregate(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)).alias("n_runs"),
        count(F.size(F.array_distinct(w))).alias("n_distinct"),
    )


def vote_code(rules: Sequence[Rule]) -> Column:
    """The groups' votes as the digits of one number, the first group's last: 0 reject, 1 abstain, 2 keep."""
    code = F.lit(0)
    for i, group in enumerate(groups_of(rules)):
        rejects = keeps = F.lit(False)
        for r in (r for r in rules if r.group == group):
            value, counts = F.expr(r.value), F.col("n_words") >= r.least
            rejects = rejects if r.reject is None else rejects | F.coalesce(counts & (value >= r.reject), F.lit(False))
            keeps = keeps if r.keep is None else keeps | F.coalesce(counts & (value <= r.keep), F.lit(False))
        code = code + F.when(rejects, 0).when(keeps, 2).otherwise(1) * 3**i
    return code.cast("int")


def group_odds(rules: Sequence[Rule]) -> list[float]:
    """The odds of each group: those of its loosest rule."""
    return [min(r.odds for r in rules if r.group == g) for g in groups_of(rules)]


def fit_patterns(counts: DataFrame, odds: Sequence[float], rounds: int = ROUNDS) -> DataFrame:
    """(pattern, n) rows -> (pattern, p_good); ``odds`` holds each group's.

    Two classes; the first guess calls a pattern bad if any group rejects, and the share of such documents stays
    the prior of the bad class: votes cannot tell how many bad documents nobody sees. A group's vote is a draw
    with a chance of rejecting in each class, an abstention no draw at all. Chances are maximum a posteriori estimates: the
    class's votes and ``BELIEF`` more as ``EXPECTED``, so the belief fades as documents come. They keep to two
    bounds: ``MOST_FOUND`` on bad documents, and on good ones the chance on bad ones over the group's odds.
    Without the second, a group that alone rejects some documents cannot be told from one that errs, and the two
    classes become one; without the first, the commonest kind of bad documents passes for all. An empty table
    gives no rows; a pattern may count 0."""
    n_groups = len(odds)
    digits = lambda p: F.transform(F.sequence(F.lit(0), F.lit(n_groups - 1)), lambda r: (F.floor(p["pattern"] / F.pow(F.lit(3.0), r)) % 3).cast("int"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    groups = F.sequence(F.lit(0), F.lit(n_groups - 1))

    def rejecting(weights: Column, ds: Column, expected: float, most: Column) -> Column:
        """P(reject | a vote) of each group, given the weight of each pattern in the class, and ``most`` of each."""
        of = lambda r, test: total(F.zip_with(weights, ds, lambda x, d: F.when(test(F.get(d, r)), x).otherwise(F.lit(0.0))))
        return F.transform(groups, lambda r: F.least((of(r, lambda v: v == 0) + BELIEF * expected) / (of(r, lambda v: v != 1) + BELIEF), F.get(most, r)))

    def step(q: Column, ns: Column, ds: Column, prior: Column) -> Column:
        bad = F.zip_with(ns, q, lambda n, x: n * x)
        good = F.zip_with(ns, q, lambda n, x: n * (1 - x))

        def posterior(b: Column, g: Column) -> Column:
            vote = lambda v, x, y: F.when(v == 0, F.log(x / y)).when(v == 2, F.log((1 - x) / (1 - y))).otherwise(0.0)
            sums = lambda d, xs, ys, p: F.aggregate(groups, p, lambda a, r: a + vote(F.get(d, r), F.get(xs, r), F.get(ys, r)))
            chances = lambda xs, ys, p: F.transform(ds, lambda d: 1 / (1 + F.exp(-F.greatest(F.least(sums(d, xs, ys, p), F.lit(500.0)), F.lit(-500.0)))))
            least_odds = lambda xs: F.zip_with(xs, F.array(*[F.lit(float(x)) for x in odds]), lambda x, y: x / y)
            most = F.transform(groups, lambda _: F.lit(MOST_FOUND))
            return let(rejecting(b, ds, EXPECTED["bad"], most), lambda xs: let(rejecting(g, ds, EXPECTED["good"], least_odds(xs)), lambda ys: chances(xs, ys, prior)))

        return let(bad, lambda b: let(good, lambda g: posterior(b, g)))

    def turn(state: Column, ns: Column, ds: Column, prior: Column) -> Column:
        moved = lambda new: F.coalesce(F.array_max(F.zip_with(new, state["q"], lambda x, y: F.abs(x - y))), F.lit(0.0))
        made = let(step(state["q"], ns, ds, prior), lambda new: F.struct(new.alias("q"), (moved(new) < CLOSE).alias("done")))
        return F.when(state["done"], state).otherwise(made)

    def fold(t: Column, ns: Column, ds: Column) -> Column:
        rejected = total(F.zip_with(ns, ds, lambda n, d: F.when(F.array_contains(d, 0), n).otherwise(F.lit(0.0))))
        first = F.struct(F.transform(ds, lambda d: F.when(F.array_contains(d, 0), 0.9).otherwise(0.05)).alias("q"), F.lit(False).alias("done"))
        return let(
            F.log((rejected + 1.0) / (total(ns) - rejected + 1.0)),
            lambda prior: F.arrays_zip(
                F.transform(t, lambda p: p["pattern"]).alias("pattern"),
                F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda state, _: turn(state, ns, ds, prior), lambda state: state["q"]).alias("p_bad"),
            ),
        )

    one = counts.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("pattern"), F.col("n")))).alias("table"))
    fitted = one.select(let(F.col("table"), lambda t: let(F.transform(t, lambda p: p["n"].cast("double")), lambda ns: let(F.transform(t, digits), lambda ds: fold(t, ns, ds)))).alias("fit"))
    return fitted.select(F.explode("fit").alias("f")).select(F.col("f")["pattern"].alias("pattern"), (1 - F.col("f")["p_bad"]).alias("p_good"))


def quality_rules(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, carry: Sequence[str] | None = None, threshold: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """``carry`` columns (all by default) with the counts, ``base_failed``, ``pattern``, ``p_good`` and ``kept``.

    A document fails the base check with fewer than 20 words or with over 30 % of its words in repeated
    8-word windows; else it is kept if ``p_good`` >= ``threshold``. A null or empty text has no words and
    so fails. The fit counts documents that pass the base check, whose fate it decides. Rows that repeat are judged alike; an empty table gives an empty result. Columns of
    ``docs`` named like an output column, in whatever case, are replaced."""
    rules = default_rules() if rules is None else rules
    made = {*BASE, "n_lines", "n_upper", "n_letters", "n_shouts", "n_runs", "n_distinct", "base_failed", "pattern", "p_good", "kept", "__text", "__words", "__lines"}
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in made]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    seen = settle(rule_features(docs, text_col, carry).withColumn("pattern", vote_code(rules)), "rule-features")
    fit = fit_patterns(seen.groupBy("pattern").agg(F.count(F.when(~failed, 1)).alias("n")), group_odds(rules), rounds)
    # at most 3 ** groups rows, by construction
    return seen.join(F.broadcast(fit), "pattern").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
