"""Secret scans in DataFrame operations only: base patterns, and weak parts that count only together.

Base spans (fixed patterns, matched from the left without overlap within a kind):
assign: a credential name, a separator and a value of 12 characters or more; access: AKIA and more, 18 characters or
more in all; hex: 16 or more lower-case hex digits.

Weak candidates are parts of a multipart credential that alone say little: identifiers (short or temporary access
ids, user and client names), secrets (short assigned values, mixed 40-character keys) and endpoints (URLs, connection
strings). Parts meet in an interval join on bins of SCOPE code points: a part's partners are the parts of another role
with at most SCOPE code points between the end of one and the start of the other, however long either is. A weak
candidate is reported only if its partners complement it. Base spans take part as identifiers (access) and secrets
(assign, hex). Weak candidates that overlap a base span are left to it. Matches of a kind do not overlap, so few parts
are within reach of a part's start, and pairs grow with the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Most code points between the end of a part and the start of its partner.
SCOPE = 160

_SEPARATOR = r"""["']?\x20*[:=]\x20*["']?"""
_ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))" + _SEPARATOR + r"([A-Za-z0-9+/_.=-]+)"
#: Pattern by family, in the order in which kinds are listed.
_PATTERNS = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
    "temporary": r"\bASIA[A-Z0-9]{12,}",
    "name": r"\b(?i:client_?id|access_?key_?id|user_?name|user|login)" + _SEPARATOR + r"[A-Za-z0-9@._-]{3,}",
    "key": r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])",
    "endpoint": r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s\"'<>]+",
}
_BASE = ("assign", "access", "hex")
#: All kinds in the order of a tie, base kinds first.
KINDS = (*_BASE, "weak_id", "weak_secret", "endpoint")
#: What a part of each kind is in a credential of several parts.
_ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}


def _matches(text: Column, kind: str) -> Column:
    """array<struct(family, i, gap, m)>: each match with what lies between it and the one before."""
    pattern = _PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    each = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")), lambda x, i: F.struct(F.lit(kind).alias("family"), i.alias("i"), F.length(x["g"]).alias("gap"), x["m"].alias("m")))
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast("array<struct<family:string,i:int,gap:int,m:string>>"))


def _kind(family: Column, m: Column) -> Column:
    value = F.length(F.regexp_extract(m, _ASSIGN, 1))
    mixed = m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    return (
        F.when(family == "assign", F.when(value >= 12, "assign").when(value >= 6, "weak_secret"))
        .when(family == "access", F.when(F.length(m) >= 18, "access").when(F.length(m) >= 12, "weak_id"))
        .when(family == "hex", "hex")
        .when(family.isin("temporary", "name"), "weak_id")
        .when((family == "key") & mixed, "weak_secret")
        .when(family == "endpoint", "endpoint")
    )


def _partners(parts: DataFrame, scope: int) -> DataFrame:
    """`parts` (row, start, rank, end, kind, role, ...; distinct) with `partners`, the parts of other roles in scope, and their `roles`; null without any.

    The later of two parts starts from the earlier one's start to `scope` beyond its end, and is looked for in the bins
    from here to there. A part covers bins by its length, so they grow with the text.
    """
    own = ["row", "start", "rank", "end", "kind"]
    span = F.struct("start", "rank", "end", "kind")
    later = parts.select("row", F.floor(F.col("start") / scope).alias("bin"), F.col("role").alias("role_b"), span.alias("b"))
    reach = parts.select("row", "role", span.alias("a"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") + scope) / scope))).alias("bin"))
    met = reach.join(later, ["row", "bin"]).where((F.col("role") != F.col("role_b")) & F.col("b.start").between(F.col("a.start"), F.col("a.end") + scope))
    view = lambda one, other, role: F.struct(F.col(one).alias("one"), F.col(other).alias("partner"), F.col(role).alias("role_b"))
    both = met.select("row", F.inline(F.array(view("a", "b", "role_b"), view("b", "a", "role")))).select("row", "one.*", "partner", "role_b")
    found = both.groupBy(*own).agg(F.sort_array(F.collect_set("partner")).alias("partners"), F.collect_set("role_b").alias("roles"))
    return parts.join(found, own, "left")


def secret_spans(docs: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """Spans per input row: doc_id, spans (array<struct(start, rank, end, kind)> by start, then rank in KINDS) and groups
    (the spans that have partners, in the same order, each with the array `partners` of such structs).

    docs: doc_id long, text string; other columns are ignored. Starts and ends count code points, ends are exclusive.
    Null and empty texts have no spans. Rows that repeat a doc_id keep their own spans; an empty table gives no rows.
    Work and memory grow with a text and its matches, not with their square.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("row", "doc_id", F.explode_outer(F.concat(*(_matches(F.col("text"), k) for k in _PATTERNS))).alias("x")).select("row", "doc_id", "x.*")
    # Starts: all gaps up to a match and all matches before it, summed within its pattern.
    so_far = Window.partitionBy("row", "family").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("m")).over(so_far)
    placed = found.select("row", "doc_id", (end - F.length("m")).alias("start"), end.alias("end"), _kind(F.col("family"), F.col("m")).alias("kind"))
    # Matches alone, a small part of the texts: searched once, though the join reads them on both sides.
    placed = materialize(placed.distinct(), "secret-parts")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    role = F.create_map(*(F.lit(x) for pair in _ROLE.items() for x in pair))[F.col("kind")]
    base = F.col("kind").isin(*_BASE)
    # Running extremes from either end: a frame that shrinks from its front would be computed anew for each row.
    by_start, from_end = (Window.partitionBy("row").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("start"), F.col("start").desc()))
    flagged = placed.where("kind is not null").select(
        "row",
        "start",
        rank.alias("rank"),
        "end",
        "kind",
        role.alias("role"),
        (F.coalesce(F.max(F.when(base, F.col("end"))).over(by_start), F.lit(0)) > F.col("start")).alias("under"),
        F.coalesce(F.min(F.when(base, F.col("start"))).over(from_end) < F.col("end"), F.lit(False)).alias("over"),
    )
    linked = _partners(flagged, scope)
    has = lambda r: F.coalesce(F.array_contains("roles", r), F.lit(False))
    complement = F.when(F.col("role") == "id", has("secret")).when(F.col("role") == "secret", has("id")).otherwise(has("id") & has("secret"))
    kept = linked.where(base | (complement & ~F.col("under") & ~F.col("over"))).select("row", F.struct("start", "rank", "end", "kind", F.coalesce("partners", F.array()).alias("partners")).alias("span"))
    per_row = kept.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("all"))
    bare = F.transform(F.coalesce("all", F.array()), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    whole = placed.select("row", "doc_id").distinct().join(per_row, "row", "left")
    return whole.select("doc_id", bare.alias("spans"), F.filter(F.coalesce("all", F.array()), lambda x: F.size(x["partners"]) > 0).alias("groups"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def secret_report(docs: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """Per input row: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans, joined), spans (all, joined) and
    groups (of each span with partners: the span, >, its partners joined; separated by semicolons)."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*_BASE))
    groups = F.concat_ws(";", F.transform("groups", lambda x: F.concat(F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")), F.lit(">"), joined(x["partners"]))))
    return secret_spans(docs, scope=scope).select("doc_id", *map(count, _BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), groups.alias("groups"))
