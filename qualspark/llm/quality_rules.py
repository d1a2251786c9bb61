"""Quality rules: text statistics by built-in functions, and decision lists learned from labelled statistics.

Rules are learned by sequential covering. A rule grows one threshold condition at a time, the one with the greatest
gain in FOIL's sense on the grow part of the labelled rows, then loses conditions from its end while that does not
lower its worth on the prune part. Rows that a kept rule covers leave, and the next rule is learned from the rest.
What comes out is a list of readable conjunctions that becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, once, rows_under, words_of

#: Labelled rows that rules are learned from, at most; taken in the order of a hash of the id.
SAMPLE_ROWS = 8_000
#: Thresholds tried per feature.
CUTS = 24
SYMBOLS = "#*$%&|<>"


#: Each class of characters that is counted, and the one letter it is folded to first.
_CLASSES = {" ": SPACES, "#": SYMBOLS, "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0": "0123456789", "!": "!?"}


def _folded(text: Column) -> Column:
    """`text` with each counted class as one letter, in a single pass."""
    return F.translate(text, "".join(_CLASSES.values()), "".join(k * len(v) for k, v in _CLASSES.items()))


def _count_of(folded: Column, letter: str) -> Column:
    return (F.length(folded) - F.length(F.replace(folded, F.lit(letter), F.lit("")))).cast("long")


def with_text_stats(docs: DataFrame) -> DataFrame:
    """`docs` with one column `stats` (struct): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and
    n_lines, n_upper, n_digits, n_marks, n_distinct for the rules.

    Null and empty texts have zeros. All in built-in functions; nothing leaves the row, however long the text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    staged = docs.select("*", F.inline(F.array(F.struct(words_of(text).alias("_w"), _folded(text).alias("_f"), lines.alias("_l")))))
    triple = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    n, empty = F.size("_w"), F.array().cast("array<bigint>")
    staged = once(staged, "_g", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), triple)).otherwise(empty))
    # Most texts repeat no window. In those that do, equal hashes stand side by side once sorted with their places.
    places = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    staged = once(staged, "_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), places))
    beside = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("_s", lambda x, i: beside(x, i - 1) | beside(x, i + 1)), lambda x: x["i"]))
    staged = once(staged, "_p", F.when(F.col("_s").isNotNull(), at).otherwise(F.array().cast("array<int>")))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    f = F.col("_f")
    stats = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.replace(f, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        _count_of(f, "#").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        _count_of(f, "A").alias("n_upper"),
        _count_of(f, "0").alias("n_digits"),
        _count_of(f, "!").alias("n_marks"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
    )
    return once(staged, "stats", stats).drop("_w", "_f", "_l", "_g", "_s", "_p")


def base_failed(stats: Column = None) -> Column:
    """The fixed base rule: fewer than 50 words, or more than half of the words in repeated windows."""
    s = F.col("stats") if stats is None else stats
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(stats: Column = None) -> dict[str, Column]:
    """What rules may test: shares, free of a text's length."""
    s = F.col("stats") if stats is None else stats
    words, chars, lines = (F.greatest(s[c], F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return {
        "symbols_per_word": s["n_symbols"] / words,
        "marks_per_word": s["n_marks"] / words,
        "upper_share": s["n_upper"] / chars,
        "digit_share": s["n_digits"] / chars,
        "dup_line_share": s["n_dup_lines"] / lines,
        "repeat_share": s["n_repeat_words"] / words,
        "distinct_share": s["n_distinct"] / words,
        "chars_per_word": s["word_chars"] / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.cut if self.above else of[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.4g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def holds(self, row: dict[str, float]) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(of)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _cuts(rows: list[tuple[dict[str, float], bool]], feature: str) -> list[float]:
    """Midpoints between neighbouring values at even ranks of the targets' and of all values."""
    out = set()
    for part in (sorted(r[feature] for r, y in rows if y), sorted(r[feature] for r, _ in rows)):
        ranks = {round(k * (len(part) - 1) / CUTS) for k in range(CUTS + 1)} if part else set()
        out |= {part[k] for k in ranks}
    values = sorted(out)
    return [(a + b) / 2 for a, b in zip(values, values[1:])]


def _count(rows, test) -> tuple[int, int]:
    hit = [y for r, y in rows if test(r)]
    return sum(hit), len(hit) - sum(hit)


def learn_rules(rows: list[tuple[dict[str, float], bool]], *, precision: float = 0.98, least: int = 8, most_rules: int = 12, most_conditions: int = 3) -> list[Rule]:
    """Ordered rules that cover the targets (True) of `rows`, each at least this precise and covering this many.

    rows: (features, target), in an order that is fixed by the caller; every third row is kept for pruning. No rows,
    or no targets, give no rules.
    """
    rules: list[Rule] = []
    rest = rows
    while len(rules) < most_rules and sum(y for _, y in rest) >= least:
        grow, prune = [r for k, r in enumerate(rest) if k % 3], rest[::3]
        conditions: list[Condition] = []
        covered = grow
        while len(conditions) < most_conditions and (pos := sum(y for _, y in covered)) < len(covered):
            best, gain, old = None, 0.0, math.log2(pos / len(covered)) if pos else 0.0
            for feature in covered[0][0]:
                ordered = sorted((r[feature], y) for r, y in covered)
                seen_pos = seen = k = 0
                for cut in _cuts(covered, feature):
                    while k < len(ordered) and ordered[k][0] <= cut:
                        seen_pos, seen, k = seen_pos + ordered[k][1], seen + 1, k + 1
                    for above, p, n in ((False, seen_pos, seen), (True, pos - seen_pos, len(ordered) - seen)):
                        if p and (g := p * (math.log2(p / n) - old)) > gain + 1e-12:
                            best, gain = Condition(feature, above, cut), g
            if best is None:
                break
            conditions.append(best)
            covered = [x for x in covered if best.holds(x[0])]
        worth = lambda cs: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_count(prune, Rule(tuple(cs), 0, 0).holds))
        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        if not conditions:
            break
        pos, neg = _count(rest, Rule(tuple(conditions), 0, 0).holds)
        if pos < least or pos < precision * (pos + neg):
            break
        rules.append(Rule(tuple(conditions), pos / (pos + neg), pos))
        rest = [x for x in rest if not rules[-1].holds(x[0])]
    return rules


def fit_quality_rules(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE_ROWS, **options) -> list[Rule]:
    """Rules for low quality (labels.quality = 0), learned on at most `sample` labelled documents.

    labels: doc_id, quality; nulls are left out. Where there are more, those with the smallest hashes of doc_id are
    taken. Documents that the base rule fails are left out, as it decides for them.
    """
    named = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_y"))
    if not rows_under(named, sample):
        named = named.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most `sample` rows, so the broadcast is bounded.
    known = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(named), "_id")
    known = with_text_stats(known).where(~base_failed())
    columns = features()
    found = known.select("_id", "_y", *(c.alias(k) for k, c in columns.items())).orderBy(F.xxhash64("_id"), "_id", *columns).limit(2 * sample).collect()
    return learn_rules([({k: r[k] for k in columns}, r["_y"] == 0) for r in found], **options)


def verdict(rules: list[Rule], stats: Column = None) -> Column:
    """The first rule that holds, by number from 1; 0 if the base rule fails a text; null if nothing speaks against it."""
    of = features(stats)
    out = F.when(base_failed(stats), 0)
    for k, rule in enumerate(rules, 1):
        out = out.when(rule.column(of), k)
    return out


def apply_quality_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """`docs` with `stats`, `rule` (see verdict; -1 if none), base_failed and kept. Rows are never dropped here.

    Columns of `docs` with one of these names, in any case, give way; all others stay, whatever they are called.
    """
    own = ("stats", "rule", "base_failed", "kept")
    names = {c: "text" if c.lower() == "text" else f"c{k}" for k, c in enumerate(docs.columns) if c.lower() not in own}
    scored = with_text_stats(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    scored = scored.withColumn("rule", F.coalesce(verdict(rules), F.lit(-1))).withColumn("base_failed", base_failed()).withColumn("kept", F.col("rule") == -1)
    return scored.select(*(F.col(n).alias(c) for c, n in names.items()), *own)
