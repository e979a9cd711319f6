"""Operator 3, secrets by patterns and a battery of randomness tests.

Everything is built-in functions over the row; nothing is shuffled but a
bounded histogram.

1. Base spans (assign, access, hex) come from patterns. The places of all
   matches follow from the lengths of the matches and of what lies between.
2. Long unbroken tokens are candidates. The encoding is inferred from the
   characters: the smallest of decimal, hex whatever its case, letters, base32,
   letters and digits (each of one case or both), base64. Against a uniform draw
   from that alphabet three tests are made: chi-squared of the symbol counts
   with its exact mean and variance, runs above and below the middle symbol,
   and serial correlation at lag one. Fisher's method joins their p-values; a
   token that is not random enough is no secret.
3. Against ordinary identifiers two statistics give a p-value whose power
   grows with the length: changes between letters and digits or cases, and
   repeated letters, whatever their case, compared with European text. These p-values are
   hypotheses of one family per length band, and the Benjamini-Hochberg
   bound, on a histogram of all candidates, controls false discoveries.

Defined results: a null text is empty and has no spans. Rows are handled one
by one, so repeated rows and ids give repeated results; an empty table gives
an empty result. Other columns of ``docs`` are not read. Added spans never
overlap base spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.registry import documents, query
from lumenrank.llm.text import let
from lumenrank.session import materialise

BASE_KINDS = ("assign", "access", "hex")
RANDOM = "random"

ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
TOKEN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"

RATE = 0.01  # false discoveries among the added tokens of a length band
NOT_RANDOM = 0.001  # joint p-value below which a token is not random
BANDS = (20, 32, 48, 96)  # lower ends of the length bands
BINS_PER_DECADE, TOP_BIN = 10, 400

# Chance that two letters of European text are equal, and that three are.
PAIR_MATCH, TRIPLE_MATCH = 0.066, 0.0055
# Share of neighbours of unlike class (lower, upper, digit, mark) in ordinary identifiers.
CLASS_CHANGE = 0.2
DIGIT_SHARE = 0.3  # of a word of text made of hex digits, at most

_SPAN = "array<struct<start:bigint,kind_order:int,end:bigint,kind:string>>"


def _prefix_sums(values: Column) -> Column:
    """Sum of all earlier elements for each, in blocks, so that long arrays stay near linear."""
    block = F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int")
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), block)).otherwise(F.array().cast("array<int>"))

    def running(part: Column, base: Column) -> Column:
        start = F.struct(base.alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(part, start, lambda acc, x: F.struct((acc.s + x).alias("s"), F.array_append(acc.a, acc.s).alias("a")))

    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<array<bigint>>").alias("a"))
    done = F.aggregate(
        starts, start,
        lambda acc, at: let(
            running(F.slice(values, at, block), acc.s),
            lambda r: F.struct(r.s.alias("s"), F.array_append(acc.a, r.a).alias("a")),
        ),
    )
    return F.flatten(done.a)


def matches(body: Column, pattern: str, keep: Column | None = None) -> Column:
    """``start, end, value`` of every leftmost non-overlapping match; places in code points, the end exclusive.

    ``keep`` is an array of booleans, one per match.
    """
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    between = F.split(body, pattern, -1)

    def place(ms: Column) -> Column:
        steps = F.zip_with(
            F.slice(between, 1, F.size(ms)), ms, lambda b, m: (F.length(b) + F.length(m)).cast("bigint")
        )
        return let(
            steps,
            lambda st: let(
                _prefix_sums(st),
                lambda before: F.transform(
                    ms,
                    lambda m, i: F.struct(
                        (F.get(before, i) + F.get(st, i) - F.length(m)).cast("bigint").alias("start"),
                        (F.get(before, i) + F.get(st, i)).cast("bigint").alias("end"),
                        m.alias("value"),
                    ),
                ),
            ),
        )

    placed = let(found, place)
    if keep is not None:
        placed = F.transform(
            F.filter(F.arrays_zip(placed.alias("m"), keep.alias("k")), lambda x: x.k), lambda x: x.m
        )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(body.rlike(pattern), placed).otherwise(empty)


def _named(found: Column, order: int, kind: str) -> Column:
    """Places of matches as spans of a kind."""
    return F.transform(
        found,
        lambda m: F.struct(
            m.start.alias("start"), F.lit(order).alias("kind_order"), m.end.alias("end"), F.lit(kind).alias("kind")
        ),
    ).cast(_SPAN)


def base_spans(body: Column) -> Column:
    """Base spans of a text as an array of structs, by start and kind."""
    long_enough = F.transform(F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 8)
    found = (matches(body, ASSIGN, long_enough), matches(body, ACCESS), matches(body, HEX))
    spans = [_named(m, order, kind) for order, (kind, m) in enumerate(zip(BASE_KINDS, found))]
    return F.sort_array(F.concat(*spans))


def normal_tail(z: Column) -> Column:
    """P(Z > z) by the rational approximation of the error function; relative error is small in both tails used."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    # Coefficients of the complementary error function by Chebyshev fit.
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    half = t * F.exp(poly - x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _fisher(ps: list[Column]) -> Column:
    """Joint p-value of two or three independent ones."""
    x = F.lit(0.0)
    for p in ps:
        x = x - F.log(F.greatest(p, F.lit(1e-300)))
    tail = 1 + x + (x * x / 2 if len(ps) == 3 else F.lit(0.0))
    return F.exp(-x) * tail


def battery(token: Column) -> Column:
    """``p_random`` and ``p_text`` of a token of ASCII letters, digits and ``+/_-``, without padding."""
    hexadecimal = token.rlike("^[0-9A-Fa-f]+$") & ~token.rlike("^[0-9]+$")
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabet = (
        F.when(token.rlike("^[0-9]+$"), F.lit(digits))
        .when(hexadecimal, F.lit("0123456789abcdef"))
        .when(token.rlike("^[A-Z]+$"), F.lit(upper))
        .when(token.rlike("^[a-z]+$"), F.lit(lower))
        .when(token.rlike("^[A-Z2-7]+$"), F.lit(upper + "234567"))
        .when(token.rlike("^[a-z2-7]+$"), F.lit(lower + "234567"))
        .when(token.rlike("^[A-Z0-9]+$"), F.lit(upper + digits))
        .when(token.rlike("^[a-z0-9]+$"), F.lit(lower + digits))
        .when(token.rlike("^[A-Za-z]+$"), F.lit(upper + lower))
        .when(token.rlike("^[A-Za-z0-9]+$"), F.lit(upper + lower + digits))
        .otherwise(F.lit(upper + lower + digits + "+/"))
    )
    plain = F.translate(token, "-_", "+/")
    symbols = F.when(hexadecimal, F.lower(plain)).otherwise(plain)  # the case of hex digits says nothing
    classes = F.split(F.translate(
        plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "A" * 26 + "a" * 26 + "0" * 10 + "++"
    ), "")

    def squares(text: Column, chars: Column) -> Column:
        """Sum of the squared counts of the symbols."""
        return F.aggregate(
            F.array_distinct(chars), F.lit(0.0),
            lambda acc, c: acc + F.pow((F.length(text) - F.length(F.replace(text, c))).cast("double"), F.lit(2.0)),
        )

    def measure(x: Column) -> Column:
        """x: text, alphabet, chars, classes."""
        n, k = F.length(x.text).cast("double"), F.length(x.alphabet).cast("double")
        folded = F.lower(x.text)
        values = F.transform(x.chars, lambda c: F.instr(x.alphabet, c).cast("double") - (F.length(x.alphabet) + 1) / 2)
        inner = F.sequence(F.lit(1), F.length(x.text) - 1)
        return let(
            F.struct(
                values.alias("v"), squares(x.text, x.chars).alias("sq"),
                squares(folded, F.transform(x.chars, lambda c: F.lower(c))).alias("folded"), n.alias("n"), k.alias("k"),
            ),
            lambda y: F.struct(
                y.n.alias("n"), y.k.alias("k"), y.sq.alias("sq"), y.folded.alias("folded"),
                F.aggregate(inner, F.lit(0.0), lambda acc, i: acc + F.get(y.v, i) * F.get(y.v, i - 1)).alias("lag"),
                F.size(F.filter(inner, lambda i: (F.get(y.v, i) > 0) != (F.get(y.v, i - 1) > 0))).cast("double").alias("turns"),
                F.size(F.filter(y.v, lambda v: v > 0)).cast("double").alias("high"),
                F.size(F.filter(inner, lambda i: F.get(x.classes, i) != F.get(x.classes, i - 1))).cast("double").alias("changes"),
                F.size(F.filter(x.classes, lambda c: c == "0")).cast("double").alias("digits"),
            ),
        )

    def tests(m: Column) -> Column:
        n, k, low = m.n, m.k, m.n - m.high
        chi = k / n * m.sq - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        product = 2 * m.high * low
        spread = F.sqrt(F.greatest(product * (product - n) / (n * n * (n - 1)), F.lit(1e-9)))
        z_runs = F.when(product > 0, (m.turns - product / n) / spread).otherwise(F.sqrt(n))
        variance = (k * k - 1) / 12
        z_lag = m.lag / (variance * F.sqrt(n - 1))
        p_random = _fisher([normal_tail(z_chi), 2 * normal_tail(F.abs(z_runs)), 2 * normal_tail(F.abs(z_lag))])
        z_change = (m.changes - 0.5 - (n - 1) * CLASS_CHANGE) / F.sqrt((n - 1) * CLASS_CHANGE * (1 - CLASS_CHANGE))
        pairs = (m.folded - n) / (n * (n - 1))
        spread_pairs = F.sqrt(
            (4 * (n - 2) * (TRIPLE_MATCH - PAIR_MATCH**2) + 2 * (PAIR_MATCH - PAIR_MATCH**2)) / (n * (n - 1))
        )
        z_digits = (m.digits - 0.5 - n * DIGIT_SHARE) / F.sqrt(n * DIGIT_SHARE * (1 - DIGIT_SHARE))
        p_match = (
            F.when(k > 16, normal_tail((PAIR_MATCH - pairs) / spread_pairs))
            .when(k == 16, normal_tail(z_digits))  # six letters match too often to tell
            .otherwise(F.lit(1.0))
        )
        return F.struct(p_random.alias("p_random"), _fisher([normal_tail(z_change), p_match]).alias("p_text"))

    def chars(s: Column) -> Column:
        return F.filter(F.split(s, ""), lambda c: c != "")

    held = F.struct(
        symbols.alias("text"), alphabet.alias("alphabet"), chars(symbols).alias("chars"), classes.alias("classes")
    )
    return let(let(held, measure), tests)


def tested_tokens(body: Column, base: Column) -> Column:
    """Candidates of a text: place, length band, p-value bin, and whether it may be added."""
    return F.transform(
        matches(body, TOKEN),
        lambda m: let(
            F.rtrim(m.value, F.lit("=")),
            lambda t: let(
                battery(t),
                lambda r: F.struct(
                    m.start.alias("start"), m.end.alias("end"),
                    sum(((F.length(t) >= b).cast("int") for b in BANDS[1:]), F.lit(0)).alias("band"),
                    F.least(
                        F.floor(-F.log10(F.greatest(r.p_text, F.lit(1e-300))) * BINS_PER_DECADE), F.lit(TOP_BIN)
                    ).cast("int").alias("bin"),
                    (
                        (r.p_random >= NOT_RANDOM)
                        & ~F.exists(base, lambda b: (b.start < m.end) & (m.start < b.end))
                    ).alias("free"),
                ),
            ),
        ),
    )


def discovery_bins(histogram: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """Per length band, the lowest bin that the Benjamini-Hochberg bound lets through: rows of band, bin, count."""
    found = {}
    for band in {b for b, _, _ in histogram}:
        own = sorted(((i, n) for b, i, n in histogram if b == band), reverse=True)
        total, above = sum(n for _, n in own), 0
        for bin_, n in own:
            above += n
            if 10 ** (-bin_ / BINS_PER_DECADE) * total / above <= rate:
                found[band] = bin_
    return found


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ","
    )


def _count_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """``doc_id``, counts of base spans, ``base`` and ``spans`` for every row."""
    body = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    spotted = body.select("doc_id", "body", base_spans(F.col("body")).alias("base"))
    tested = materialise(
        spotted.select("doc_id", "base", tested_tokens(F.col("body"), F.col("base")).alias("tokens")), "tokens"
    )
    counts = tested.select(F.explode("tokens").alias("t")).groupBy("t.band", "t.bin").count()
    bins = discovery_bins([tuple(r) for r in counts.collect()], rate)  # bands x bins at most
    passed = F.lit(False)

    def let_through(t: Column) -> Column:
        ok = passed
        for band, bin_ in bins.items():
            ok = ok | ((t.band == band) & (t.bin >= bin_))
        return ok & t.free

    added = _named(F.filter("tokens", let_through), len(BASE_KINDS), RANDOM)
    counted = [_count_kind(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return tested.select(
        "doc_id", *counted, _joined(F.col("base")).alias("base"),
        _joined(F.sort_array(F.concat(F.col("base"), added))).alias("spans"),
    )


@query()
def op3_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")
