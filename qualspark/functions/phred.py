"""Phred arithmetic: quality to error probability and back, exact mean quality, posterior quality shifts."""

from __future__ import annotations

import decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Qualities below LEAST_Q are neither counted nor changed; MOST_Q is the largest that a model holds.
LEAST_Q, MOST_Q = 6, 42
#: Qualities that have a letter. A model adds the shifts of a cycle and of a context, so a sum may lie below 0: from counts, down to -17.
LEAST_LETTER, MOST_LETTER = -32, 93
_PLACES = decimal.Decimal(1).scaleb(-26)
#: Probabilities of 26 places are held in two parts of 13 digits.
LIMB = 10**13


def q_to_p(q: Column) -> Column:
    """Error probability of a quality."""
    return F.pow(F.lit(10.0), -q / F.lit(10.0))


def p_to_q(p: Column, most: int = MOST_Q) -> Column:
    """Quality of a probability, cut toward zero and held to 0..most; probability 0 gives `most`."""
    return F.when(p == 0, F.lit(most)).otherwise(F.greatest(F.lit(0), F.least(F.lit(most), (-10 * F.log10(p)).cast("int"))))


def char_q(c: Column) -> Column:
    """Quality of a Phred+33 character."""
    return F.ascii(c) - 33


def q_char(q: Column) -> Column:
    """Phred+33 character of a quality, those below 0 included; one outside LEAST_LETTER..MOST_LETTER fails."""
    return F.when(q.between(LEAST_LETTER, MOST_LETTER), F.char(q + 33)).otherwise(F.raise_error(F.concat(F.lit("quality cannot be written: "), q.cast("string"))))


def double_p(q: int) -> str:
    """The double nearest 10^(-q/10), as its exact decimal expansion to 26 places."""
    return f"{decimal.Decimal(10 ** (-q / 10)).quantize(_PLACES):f}"


def true_p(q: int) -> str:
    """10^(-q/10) itself to 26 places."""
    with decimal.localcontext(prec=60):
        return f"{(decimal.Decimal(10) ** (decimal.Decimal(-q) / 10)).quantize(_PLACES):f}"


def limbs(p: str) -> tuple[int, int]:
    """A probability of 26 places as two whole numbers of 13 digits: p = (high * 10^13 + low) / 10^26."""
    return divmod(int(decimal.Decimal(p).scaleb(26)), LIMB)


def _limb(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(str(v)).cast("decimal(14,0)") for v in values)), at)


def expected_errors(q: Column, n: Column) -> tuple[Column, Column]:
    """Expected errors of n bases of quality q as a high and a low part, whole numbers whose sums stay exact for any count."""
    high, low = zip(*(limbs(double_p(k)) for k in range(MOST_Q + 1)), strict=True)
    count = n.cast("decimal(19,0)")
    return _limb(high, q + 1) * count, _limb(low, q + 1) * count


def _carried(high: Column, low: Column) -> tuple[Column, Column]:
    """The same number with a low part below LIMB."""
    size, wide = F.lit(str(LIMB)).cast("decimal(14,0)"), low.cast("decimal(38,0)")
    over = F.floor(wide / size)
    # Division may round: the rest tells whether it did.
    rest = wide - over * size
    over = F.when(rest < 0, over - 1).when(rest >= size, over + 1).otherwise(over)
    return high.cast("decimal(38,0)") + over.cast("decimal(30,0)"), wide - over * size


def mean_q(high: Column, low: Column, n: Column) -> Column:
    """floor(-10 log10(errors / n)) without rounding at the borders: how many thresholds times n the errors do not exceed.

    high, low: sums of expected_errors. Both sides are compared by their parts, so no count is too large.
    """
    above, rest = _carried(high, low)
    borders = F.array(*(F.struct(F.lit(str(h)).cast("decimal(14,0)").alias("h"), F.lit(str(x)).cast("decimal(14,0)").alias("l")) for h, x in (limbs(true_p(k)) for k in range(1, MOST_Q + 1))))
    count = n.cast("decimal(24,0)")

    def reached(t: Column) -> Column:
        h, x = _carried(t["h"] * count, t["l"] * count)
        return (above < h) | ((above == h) & (rest <= x))

    return F.size(F.filter(borders, reached))


def posterior_q(prior: Column, errors: Column, n: Column) -> Column:
    """The quality 1..MOST_Q that best explains `errors` in `n` bases given a prior quality; ties go to the lowest.

    The prior falls off as a normal curve over whole steps and is zero from 19 steps on; one error and one non-error
    are added to the counts.
    """

    def weigh(c: Column) -> Column:
        step, p = F.abs((c - prior).cast("int")), F.pow(F.lit(10.0), -c / F.lit(10.0))
        fit = (errors + 1) * F.log(p) + (n - errors + 1) * F.log(1 - p) - 2.0 * step * step
        return F.struct(F.when(step < 19, fit).otherwise(F.lit(float("-inf"))).alias("fit"), (-c).alias("less"))

    return -F.array_max(F.transform(F.sequence(F.lit(1), F.lit(MOST_Q)), weigh))["less"]
