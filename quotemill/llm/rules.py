"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once per document.  The ledger keeps what was measured and one bit per failed rule, so
a policy (a versioned choice of rules) is a mask: applying another version, or asking what a rule costs, reads
the small ledger and never the texts again.

Defined results: a null or empty text has no words, measurements of 0 and fails ``few_words``.  Repeated rows
are measured each for itself.  Columns of the input other than id and text do not take part; of an input
column and a ledger column of one name, the ledger's is returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import SPACES, fresh, only

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_upper", "n_stutters")

# A rule's place in this list is its bit; only append.  Each is a SQL condition over the measurements that holds
# when the document fails.  All ratios are compared as products, so no row divides by zero.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "10 * n_symbols > 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines AND n_dup_lines >= 2"),
    ("shouting", "10 * n_upper > 3 * word_chars"),
    ("exclamations", "10 * n_exclaims > 2 * n_words"),
    ("stutters", "100 * n_stutters > 30 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force: a document passes if at most ``allowed`` of the named rules failed."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return sum(bit(r) for r in self.rules)

    def passes(self, failures: Column) -> Column:
        return F.bit_count(failures.bitwiseAND(F.lit(self.mask).cast("long"))) <= self.allowed


def bit(rule: str) -> int:
    return 1 << [name for name, _ in RULES].index(rule)


BASE = ("few_words", "repeated_windows")
POLICIES = {
    "v1": Policy("v1", (*BASE, "many_symbols")),
    "v2": Policy("v2", tuple(name for name, _ in RULES)),
}
CURRENT = "v2"


def with_repeats(df: DataFrame, words: str, out: str, width: int = WINDOW) -> DataFrame:
    """Add how many words lie in windows of ``width`` words that occur twice or more in the array column ``words``.

    Windows are sorted by hash, so equal ones are neighbours; the positions of those with a neighbour are sorted
    again and the length of the union of their spans is summed: n log n in the row's own words.  Each array is a
    column of its own, since an array named inside a lambda would be built again for every element.
    """
    hashes, windows, places = fresh(df, "_hashes", "_windows", "_places")
    h, w, n = F.col(hashes), F.col(windows), F.size(hashes)
    none = F.array().cast("array<int>")
    starts = F.when(n >= width, F.sequence(F.lit(1), n - (width - 1))).otherwise(none)
    df = df.withColumn(hashes, F.transform(words, lambda x: F.xxhash64(x)))
    hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.element_at(h, i + k) for k in range(width)]).alias("h"), i.alias("at")))
    df = df.withColumn(windows, F.sort_array(hashed))
    following = F.transform(w, lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b")))
    pairs = F.filter(following, lambda p: p["a"]["h"] == p["b"]["h"])
    both = F.flatten(F.transform(pairs, lambda p: F.array(p["a"]["at"], p["b"]["at"])))
    df = df.withColumn(places, F.sort_array(both))
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def reach(s: Column, p: Column) -> Column:
        return F.struct((s["n"] + F.greatest(p + width - F.greatest(p, s["end"]), F.lit(0))).cast("long").alias("n"), (p + width).alias("end"))

    df = df.withColumn(out, F.aggregate(places, state, reach, lambda s: s["n"]))
    return df.drop(hashes, windows, places)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: id, the measurements, and ``failures`` with bit i set where rule i failed.

    With ``keep`` all input columns stay in front and the ledger comes as one struct column ``ledger`` (or the next
    free name), for filters that must not lose or rename columns.
    """
    base = docs if keep else only(docs, **{id_col: id_col, text_col: text_col})
    at, text, words, lines, repeats = fresh(base, "ledger", "_text", "_words", "_lines", "_repeats")
    t, w, ln = F.col(text), F.col(words), F.col(lines)
    step = base.withColumn(text, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    step = step.withColumns({
        words: F.filter(F.split(F.translate(t, SPACES, " " * len(SPACES)), " "), lambda x: x != ""),
        lines: F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != ""),
    })
    step = with_repeats(step, words, repeats)
    measured = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(t, SPACES, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
        "n_repeat_words": F.col(repeats),
        "n_lines": F.size(ln),
        "n_exclaims": (F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("")))) / 2,
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_stutters": F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))),
    }
    # A generator of one row: what stands above reads the measurements and cannot evaluate them a second time.
    once = F.explode(F.array(F.struct(*[c.cast("long").alias(k) for k, c in measured.items()])))
    step = step.select(*[F.col(f"`{c}`") for c in base.columns], once.alias(at))
    step = step.withColumn(at, F.struct(*[F.col(at)[m].alias(m) for m in MEASURES], failure_bits(at).alias("failures")))
    return step if keep else step.select(F.col(f"`{id_col}`"), f"{at}.*")


def failure_bits(struct: str) -> Column:
    """The bitmask of all rules over a struct column of measurements."""
    total = F.lit(0).cast("long")
    for i, (_, broken) in enumerate(RULES):
        sql = " ".join(f"`{struct}`.`{token}`" if token in MEASURES else token for token in broken.split(" "))
        total = total + F.when(F.expr(sql), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return total


def verdicts(book: DataFrame, policy: Policy) -> DataFrame:
    """Apply one policy version to a ledger: ``base_failed`` and ``kept``."""
    failed = F.col("failures").bitwiseAND(F.lit(sum(bit(r) for r in BASE)).cast("long")) != 0
    return book.withColumns({"base_failed": failed, "kept": ~failed & policy.passes(F.col("failures"))})


def ablations(book: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy costs: documents that only this rule rejects, and how many would pass without it.

    The ledger is first counted by bitmask (at most 2^rules rows leave the tasks); each rule is then one bitwise
    condition over those counts.  An empty ledger gives counts of 0.
    """
    mask = F.lit(policy.mask).cast("long")
    counts = book.groupBy(F.col("failures").bitwiseAND(mask).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = book.sparkSession.createDataFrame([(r, bit(r)) for r in policy.rules], "rule string, b long")
    n = F.col("n")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    hit = F.col("failed").bitwiseAND(F.col("b")) != 0
    rest = F.bit_count(F.col("failed").bitwiseAND(F.bitwise_not(F.col("b"))))
    table = counts.withColumn("rules", F.lit(1)).join(F.broadcast(rules.withColumn("rules", F.lit(1))), "rules", "right")
    return table.groupBy("rule").agg(
        F.lit(policy.version).alias("version"),
        total(hit).alias("failed"),
        total(hit & (rest <= policy.allowed) & (F.bit_count("failed") > policy.allowed)).alias("rejected_alone"),
        total(F.bit_count("failed") <= policy.allowed).alias("kept"),
        total(rest <= policy.allowed).alias("kept_without"),
    )


def apply(docs: DataFrame, policy: Policy, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass the policy and the base rules, with their own columns only."""
    book = ledger(docs, id_col, text_col, keep=True)
    at = next(c for c in book.columns if c not in docs.columns)
    failures = F.col(at)["failures"]
    base = failures.bitwiseAND(F.lit(sum(bit(r) for r in BASE)).cast("long"))
    return book.filter((base == 0) & policy.passes(failures)).drop(at)
