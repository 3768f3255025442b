"""Quality rules: text statistics and a learned decision list, as Spark expressions only.

The statistics are DataFrame functions over whole texts. The decision list is
learned by sequential covering: conditions on thresholds are grown one by one
by information gain on two thirds of the labelled rows, pruned on the rest, and
a rule that covers enough of what is to be rejected with enough precision is
kept; rows that it covers leave, and the next rule is grown. The list becomes
one ordered ``CASE WHEN``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

WS = r"[\x20\x09-\x0D]+"
#: Labelled documents that fit() reads at most (a deterministic hash sample beyond that).
SAMPLE = 6000
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "distinct_ratio", "line_words")


def with_stats(docs: DataFrame, text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """docs' columns named in ``also``, the five base statistics and the features of the rules.

    Null text: no words. Columns of docs other than these are left out, so names
    cannot clash. Levels of select() keep Catalyst from evaluating an array twice.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    only = lambda cls: F.length(F.regexp_replace("_t", f"[^{cls}]+", ""))
    df = docs.select(*also, t.alias("_t"))
    df = df.select(*also, "_t", F.array_remove(F.split("_t", WS), "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"), only(r"#*$%&|<>").alias("n_symbols"), only("A-Z").alias("_up"), only("0-9").alias("_dig"), only("!?.,;:").alias("_mark"))
    df = df.select(*also, "n_symbols", "_up", "_dig", "_mark", F.size("_w").alias("n_words"), F.length(F.array_join("_w", "")).alias("word_chars"), F.size("_l").alias("_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"), F.size(F.array_distinct("_w")).alias("_kinds"), F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    # 3-word windows by hash; only texts with a window twice are sorted to find where.
    window = lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2))
    df = df.withColumn("_3", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.col("n_words") - 3), window)))
    twice = F.size(F.array_distinct("_3")) < F.size("_3")
    df = df.withColumn("_s", F.when(twice, F.sort_array(F.transform("_3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = lambda x, k: F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))
    at = F.flatten(F.transform(F.filter("_s", again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_s").isNotNull(), F.size(F.array_distinct(at))), F.lit(0)))
    long = [F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    features = {"mean_word": share("word_chars", "n_words"), "symbol_ratio": share("n_symbols", "word_chars"), "dup_line_ratio": share("n_dup_lines", "_lines"), "repeat_ratio": share("n_repeat_words", "n_words"), "upper_ratio": share("_up", "word_chars"), "digit_ratio": share("_dig", "word_chars"), "mark_ratio": share("_mark", "n_words"), "distinct_ratio": share("_kinds", "n_words"), "line_words": share("n_words", "_lines")}
    return settled(df.select(*also, *long, *[c.alias(k) for k, c in features.items()]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class DecisionList:
    """Ordered rules; each is a list of (feature, '<=' or '>', threshold) that rejects when all hold."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def keep(self) -> Column:
        out = None
        for rule in self.rules:
            holds = F.lit(True)
            for name, op, x in rule:
                holds = holds & (F.col(name) <= F.lit(float(x)) if op == "<=" else F.col(name) > F.lit(float(x)))
            out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _covers(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, op, t in rule:
        ok &= x[:, j] <= t if op == "<=" else x[:, j] > t
    return ok


def _grow(x: np.ndarray, y: np.ndarray, most: int, cuts: int) -> list[tuple[int, str, float]]:
    rule: list[tuple[int, str, float]] = []
    while len(rule) < most and len(y) and 0 < y.sum() < len(y):
        p0 = np.log2(y.mean())
        best, gain = None, 1e-9
        for j in range(x.shape[1]):
            for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts))):
                for op, ok in (("<=", x[:, j] <= t), (">", x[:, j] > t)):
                    n, p = ok.sum(), y[ok].sum()
                    if p and (g := p * (np.log2(p / n) - p0)) > gain:
                        best, gain = (j, op, float(t)), g
        if best is None:
            break
        rule.append(best)
        ok = _covers(x, [best])
        x, y = x[ok], y[ok]
    return rule


def learn(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, precision: float = 0.95, least: int = 3, most: int = 3, cuts: int = 33) -> DecisionList:
    """Sequential covering. y: 1 to reject. Rules below ``precision`` on either part, or covering fewer than ``least`` rows, end the list."""
    out = DecisionList()
    hold = np.arange(len(y)) % 3 == 2
    gx, gy, px, py = x[~hold], y[~hold], x[hold], y[hold]
    while gy.sum() >= least:
        rule = _grow(gx, gy, most, cuts)
        if not rule:
            break

        def worth(r: list) -> float:
            ok = _covers(px, r)
            p, n = py[ok].sum(), (1 - py[ok]).sum()
            return (p - 3 * n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        g, p = _covers(gx, rule), _covers(px, rule)
        right = [part[ok].mean() if ok.any() else 0.0 for part, ok in ((gy, g), (py, p))]
        if g.sum() < least or min(right) < precision:
            break
        out.rules.append([(names[j], op, t) for j, op, t in rule])
        gx, gy, px, py = gx[~g], gy[~g], px[~p], py[~p]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", **options) -> DecisionList:
    """Learn the list from labels (doc_id, label: 0 is to be rejected); a document with several labels takes the lowest.

    Reads at most ``sample`` labelled documents (those with the least hash of
    their id); no labels give an empty list, which rejects nothing.
    """
    some = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Bounded by ``sample`` rows of two numbers.
    rows = with_stats(docs.join(F.broadcast(some), "doc_id"), also=("doc_id", "_y")).where(~base_failed())
    rows = rows.groupBy("doc_id").agg(F.min("_y").alias("_y"), *[F.min(f).alias(f) for f in FEATURES]).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    if not rows:
        return DecisionList()
    return learn(np.array([[float(r[f]) for f in FEATURES] for r in rows]), np.array([int(r["_y"] < 1) for r in rows]), **options)


def judged(docs: DataFrame, rules: DecisionList, also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``also``, the statistics, base_failed and kept."""
    stats = with_stats(docs, also=also)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keep())
