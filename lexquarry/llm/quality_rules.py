"""Quality rules: text statistics and a learned decision list, all in Spark expressions.

Statistics come from one pass over the whole texts, by built-in functions only. The list is learned by sequential
covering on labelled statistics: a rule grows by the threshold condition with the best gain until it covers no good
text of the growing part, is pruned on the other part, and is kept while precise; what it covers is taken out and the
next rule is learned. Labelled rows are first counted in cells of binned statistics by Spark; the driver sees at most
`max_labelled` cells. The result is an ordered list of conditional expressions.

Defined results: a null text has no words; texts without words fail the base rule; null or missing labels teach
nothing; without labels the list is empty and keeps what passes the base rule; texts of any length are read whole;
equal rows give equal results; columns besides id and text are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persisted, pruned

_BLANK = " \t\n\x0b\x0c\r"
_SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Bound on the labelled rows a list is learned from, the first by hash of the id.
MAX_LABELLED = 40_000
BINS = 24
MAX_RULES = 24
MAX_CONDITIONS = 4
LEAST_PRECISION = 0.92


def word_array(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANK))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT, -1))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `id`, `digest` (a hash of the text, which tells rows of one id apart) and the counts below, as bigint."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count_of = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    base = pruned(docs, id=id_col, text=text_col).select("id", text.alias("text"))
    words = base.select(
        "id",
        "text",
        word_array(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda line: F.length(F.btrim(line, F.lit(_BLANK))) > 0).alias("lines"),
    )
    hashed = words.select(
        "id",
        F.xxhash64("text").alias("digest"),
        F.size("words").alias("n_words"),
        F.length(F.translate("text", _BLANK, "")).alias("word_chars"),
        count_of(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("text", F.lit("\\p{Lu}")).alias("n_upper"),
        count_of("!?").alias("n_marks"),
        count_of("0123456789").alias("n_digits"),
        count_of(".").alias("n_stops"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    gram = lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(5)])
    none = F.array().cast("array<bigint>")
    grams = hashed.withColumn("g", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.col("n_words") - 5), gram)).otherwise(none))
    # Only texts with a repeated window sort their windows; the others are done after one hash-set pass.
    placed = grams.drop("h").withColumn(
        "s",
        F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))),
    )
    at = lambda i: F.get(F.col("s"), i)["x"]
    twice = placed.drop("g").withColumn(
        "p",
        F.sort_array(
            F.transform(
                F.filter("s", lambda e, i: F.coalesce((i > 0) & (at(i - 1) == e["x"]), F.lit(False)) | F.coalesce(at(i + 1) == e["x"], F.lit(False))),
                lambda e: e["i"],
            )
        ),
    )
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_marks", "n_digits", "n_stops")
    return twice.select("id", "digest", *[F.col(n).cast("bigint").alias(n) for n in names], F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """The statistics a rule may test; never null."""
    words, chars, lines = (F.greatest(F.col(n), F.lit(1)).cast("double") for n in ("n_words", "word_chars", "n_lines"))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "marks_per_word": F.col("n_marks") / words,
        "stops_per_word": F.col("n_stops") / words,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "repeated_share": F.col("n_repeat_words") / words,
        "repeated_lines": F.col("n_dup_lines") / lines,
        "words_per_line": words / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, known: dict[str, Column]) -> Column:
        value = known[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects the text, else it is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def first_match(self) -> Column:
        """Number of the first rule that holds, from 1; 0 if none."""
        known, out = features(), None
        for k, rule in enumerate(self.rules, 1):
            held = rule[0].column(known)
            for c in rule[1:]:
                held = held & c.column(known)
            out = F.when(held, k) if out is None else out.when(held, k)
        return F.lit(0) if out is None else out.otherwise(0)


def learn_rules(statistics: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Rules for label 0 from at most max_labelled labelled rows."""
    picked = pruned(labels, lid="doc_id", good="quality").where("lid IS NOT NULL AND good IS NOT NULL").dropDuplicates(["lid"])
    picked = picked.orderBy(F.xxhash64("lid"), "lid").limit(max_labelled)
    known = features()
    rows = statistics.join(F.broadcast(picked), F.col("id") == F.col("lid")).where(~base_failed())
    rows = rows.select(*[c.alias(n) for n, c in known.items()], (F.col("good") == 0).alias("bad"), (F.pmod(F.xxhash64(F.col("lid") + 1), F.lit(3)) == 0).alias("prune"))
    rows = persisted(statistics.sparkSession, rows)
    names = list(known)
    shares = [k / BINS for k in range(1, BINS)] + [0.99, 0.999]
    quantiles = rows.agg(*[F.percentile_approx(n, shares, 2000).alias(n) for n in names]).first()
    cuts = {n: sorted(set(quantiles[n] or [])) for n in names}
    bins = [sum((F.when(F.col(n) > t, 1).otherwise(0) for t in cuts[n]), F.lit(0)).alias(n) for n in names]
    cells = [tuple(r) for r in rows.select(*bins, "bad", "prune").groupBy(*names, "bad", "prune").count().collect()]
    learned = DecisionList(tuple(tuple(Condition(names[f], up, cuts[names[f]][k]) for f, up, k in rule) for rule in cover(cells, [len(cuts[n]) for n in names])))
    return _centred(rows, learned)


def _centred(rows: DataFrame, learned: DecisionList) -> DecisionList:
    """Move each threshold half way to the bad texts that its rule covers, so that good texts just beyond stay kept."""
    if not learned.rules:
        return learned
    own = {n: F.col(n) for n in features()}
    asked = []
    for k, rule in enumerate(learned.rules):
        held = F.col("bad")
        for c in rule:
            held = held & c.column(own)
        asked += [F.percentile_approx(F.when(held, F.col(c.feature)), 0.02 if c.above else 0.98, 2000).alias(f"r{k}_{j}") for j, c in enumerate(rule)]
    edges = rows.agg(*asked).first()
    moved = []
    for k, rule in enumerate(learned.rules):
        edge = [edges[f"r{k}_{j}"] for j in range(len(rule))]
        moved.append(tuple(c if e is None else Condition(c.feature, c.above, (c.threshold + e) / 2) for c, e in zip(rule, edge)))
    return DecisionList(tuple(moved))


def _holds(cell: tuple, rule) -> bool:
    return all((cell[f] > k) == up for f, up, k in rule)


def _mass(cells: list[tuple], rule) -> tuple[int, int]:
    bad = good = 0
    for c in cells:
        if _holds(c, rule):
            if c[-3]:
                bad += c[-1]
            else:
                good += c[-1]
    return bad, good


def cover(cells: list[tuple], cuts: list[int]) -> list[tuple[tuple[int, bool, int], ...]]:
    """Sequential covering over cells (bin per feature, bad, prune, count); conditions (feature, above, cut number)."""
    rules = []
    while len(rules) < MAX_RULES:
        grow, prune = [c for c in cells if not c[-2]], [c for c in cells if c[-2]]
        rule = _grown(grow, cuts)
        if not rule:
            break
        rule = _pruned(prune, rule)
        bad, good = _mass(cells, rule)
        seen_bad, seen_good = _mass(prune, rule)
        if bad + good < 10 or bad < LEAST_PRECISION * (bad + good) or seen_bad < LEAST_PRECISION * (seen_bad + seen_good) or not seen_bad:
            break
        rules.append(rule)
        cells = [c for c in cells if not _holds(c, rule)]
    return rules


def _grown(cells: list[tuple], cuts: list[int]):
    """Add the condition with the best gain in information until no good text is covered."""
    rule: tuple = ()
    while len(rule) < MAX_CONDITIONS:
        hist = [[[0, 0] for _ in range(n + 1)] for n in cuts]
        for c in cells:
            for f in range(len(cuts)):
                hist[f][c[f]][c[-3]] += c[-1]
        good, bad = (sum(h[i] for h in hist[0]) for i in (0, 1)) if cuts else (0, 0)
        if not bad or not good:
            break
        now, best = math.log2(bad / (bad + good)), (0.0, None)
        for f, n in enumerate(cuts):
            low_good = low_bad = 0
            for k in range(n):
                low_good += hist[f][k][0]
                low_bad += hist[f][k][1]
                for up, b, g in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                    if b and (gain := b * (math.log2(b / (b + g)) - now)) > best[0]:
                        best = gain, (f, up, k)
        if best[1] is None:
            break
        rule += (best[1],)
        cells = [c for c in cells if _holds(c, (best[1],))]
    return rule


def _pruned(cells: list[tuple], rule):
    """Drop last conditions while that does not lower (bad - 2 good) / (bad + good) on the pruning part: a good text lost counts twice."""

    def worth(r) -> float:
        bad, good = _mass(cells, r)
        return (bad - 2 * good) / (bad + good) if bad + good else -2.0

    best = rule
    for n in range(len(rule) - 1, 0, -1):
        if worth(rule[:n]) >= worth(best):
            best = rule[:n]
    return best


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document: `id`, `digest`, its statistics, base_failed, rule (0: none) and kept."""
    statistics = persisted(docs.sparkSession, text_statistics(docs, id_col, text_col))
    learned = learn_rules(statistics, labels, max_labelled)
    judged = statistics.withColumn("base_failed", base_failed()).withColumn("rule", learned.first_match())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def digest_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    judged = judge_quality(docs, labels)
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
