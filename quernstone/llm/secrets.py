r"""Secret scans: fixed patterns and a battery of randomness tests (DataFrame functions only).

The battery looks at maximal runs of token characters that no fixed pattern covers. The encoding
is inferred from the characters in use; over its alphabet three statistics are taken: chi-squared
against uniform letters, the runs test about the median, and lag-one serial correlation. The null
hypothesis of each is that the token is *structured*: that it departs from randomness by at least
what words do. For chi-squared that is a noncentrality that grows with the length, for the other
two a margin times the root of the length, so short tokens can't pass by lack of evidence. A token
is random if all three reject (the largest of the three p-values).

That p-value can't get small for short tokens, so a second one stands beside it: the likelihood of
the token as written by people (classes of characters that stay or change as in words and names,
letters as frequent as in running text) over its likelihood as uniform letters. Where the former is
the truth, the ratio is below p with a chance of at most p. It counts only for tokens in which the
three statistics and repeated pairs of letters show no departure from uniform letters. The lesser of the two p-values, doubled, is
the token's, and Benjamini-Hochberg within each encoding and length band holds the share of false
discoveries at `fdr`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import checkpoint, read, stored
from quernstone.llm.spans import match_ends

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 or more; runs are maximal, so this drops the failing ones
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: The first whose characters cover the token is its encoding.
ENCODINGS = (
    ("decimal", DIGITS),
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("lower", LOWER),
    ("upper", UPPER),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("BASE36", DIGITS + UPPER),
    ("letters", UPPER + LOWER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("url64", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", UPPER + LOWER + DIGITS + "+/-_"),
)
LETTER_COINCIDENCE = 0.0667  # chance that two letters of running text agree
MARGIN = 0.65
#: Per cent of a to z in English text, and the part of a letter's chance that is the same for all.
FREQUENT = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
EVEN = 0.15
#: Chances of the class (upper, lower, digit, sign) after each class: one that stays, and one of CamelCase names.
STAYING = {a: {b: 0.85 if a == b else 0.05 for b in "ULDS"} for a in "ULDS"}
NAMES = {
    "U": {"U": 0.5, "L": 0.45, "D": 0.025, "S": 0.025}, "L": {"U": 0.1, "L": 0.78, "D": 0.06, "S": 0.06},
    "D": {"U": 0.1, "L": 0.1, "D": 0.7, "S": 0.1}, "S": {"U": 0.25, "L": 0.5, "D": 0.15, "S": 0.1},
}
FAR = 3.5  # deviations from uniform letters beyond which the likelihoods don't count
BANDS = (20, 32, 48, 64)
STEPS = 100  # p-values are kept as steps of -log10, rounded to the cautious side
ALPHA = 0.05


def _spans(text: Column, regex: str, matches: Column) -> Column:
    return F.when(F.size(matches) > 0, match_ends(F.split(text, regex, -1), matches)).otherwise(
        F.expr("cast(array() as array<struct<s:int,e:int>>)")
    )


def _normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17; absolute error below 8e-8."""
    t = F.lit(1.0) / (F.abs(x) * 0.2316419 + 1.0)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2.0) * 0.3989422804014327 * poly
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def _encoding(token: Column) -> Column:
    whens = None
    for name, letters in ENCODINGS:
        test = token.rlike("^[" + letters.replace("-", r"\-") + "]+$")
        whens = F.when(test, F.lit(name)) if whens is None else whens.when(test, F.lit(name))
    return whens.otherwise(F.lit("mixed"))


def _bits(chances: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for key, p in chances.items() for x in (key, -math.log2(p))])


def _written_bits(token: Column) -> Column:
    """Bits of the token as written by people, by the better of the two ways of changing classes."""
    total = sum(FREQUENT)
    letters = {a: (1 - EVEN) * f / total + EVEN / 26 for a, f in zip(LOWER, FREQUENT)}
    chances = letters | {a.upper(): p for a, p in letters.items()} | dict.fromkeys(DIGITS, 0.1) | dict.fromkeys("+/-_", 0.25)
    classes = F.split(F.translate(token, UPPER + LOWER + DIGITS + "+/-_", "U" * 26 + "L" * 26 + "D" * 10 + "S" * 4), "")
    size = F.length(token) - 1
    steps = F.zip_with(F.slice(classes, F.lit(1), size), F.slice(classes, F.lit(2), size), lambda a, b: F.concat(a, b))
    add = lambda xs, bits: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + F.element_at(bits, x))
    ways = [add(steps, _bits({a + b: p for a, row in way.items() for b, p in row.items()})) for way in (STAYING, NAMES)]
    return add(F.split(token, ""), _bits(chances)) + F.least(*ways) + 3.0  # one for the way, two for the first class


def _repeats(token: Column) -> Column:
    """Pairs of neighbouring characters that stand in the token before."""
    letters, size = F.split(token, ""), F.length(token) - 1
    pairs = F.zip_with(F.slice(letters, F.lit(1), size), F.slice(letters, F.lit(2), size), lambda a, b: F.concat(a, b))
    return (size - F.size(F.array_distinct(pairs))).cast("double")


def randomness(tokens: Column) -> Column:
    """array<struct<s, e, stratum, step, best>> from array<struct<s, e, token>>.

    `stratum` is encoding/length band and `step` the p-value of the battery in STEPS of -log10,
    rounded down (a larger p-value); `best` is twice the lesser of that and the likelihoods' ratio.
    Padding '=' isn't part of what is tested.
    """
    body = F.transform(tokens, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.rtrim(F.translate(c["token"], "=", " ")).alias("t")))
    coded = F.transform(body, lambda c: F.struct(c["s"], c["e"], c["t"], _encoding(c["t"]).alias("enc")))
    alphabet = F.create_map(*[F.lit(x) for pair in ENCODINGS for x in pair])
    lettered = F.transform(
        coded, lambda c: F.struct(c["s"], c["e"], c["t"], c["enc"], F.element_at(alphabet, c["enc"]).alias("abc"))
    )
    indexed = F.transform(
        lettered,
        lambda c: F.struct(
            c["s"],
            c["e"],
            c["enc"],
            F.length(c["t"]).cast("double").alias("n"),
            F.length(c["abc"]).cast("double").alias("k"),
            F.aggregate(
                F.split(c["abc"], ""),
                F.lit(0.0),
                lambda acc, a: acc
                + F.pow((F.length(c["t"]) - F.length(F.replace(c["t"], a, F.lit("")))).cast("double"), F.lit(2.0)),
            ).alias("squares"),
            F.transform(F.split(c["t"], ""), lambda x: F.instr(c["abc"], x).cast("double") - 1.0).alias("x"),
            _written_bits(c["t"]).alias("written"),
            _repeats(c["t"]).alias("again"),
        ),
    )
    pairs = lambda c: F.zip_with(  # noqa: E731  each character with the one before; the first with the last
        F.concat(F.slice(c["x"], -1, 1), F.slice(c["x"], F.lit(1), F.size(c["x"]) - 1)),
        c["x"],
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))
    summed = F.transform(
        indexed,
        lambda c: F.struct(
            c["s"],
            c["e"],
            c["enc"],
            c["n"],
            c["k"],
            c["written"],
            c["again"],
            (c["squares"] * c["k"] / c["n"] - c["n"]).alias("chi"),
            total(c["x"], lambda x: x).alias("sx"),
            total(c["x"], lambda x: x * x).alias("sxx"),
            total(pairs(c), lambda p: p["a"] * p["b"]).alias("sxy"),
            total(c["x"], lambda x: F.when(x > (c["k"] - 1.0) / 2.0, 1.0).otherwise(0.0)).alias("high"),
            # circular changes, so runs = changes, or changes + 1 where the ends differ in side less one
            total(
                pairs(c),
                lambda p: F.when(
                    (p["a"] > (c["k"] - 1.0) / 2.0) != (p["b"] > (c["k"] - 1.0) / 2.0), 1.0
                ).otherwise(0.0),
            ).alias("turns"),
        ),
    )

    def tested(c: Column) -> Column:
        n, k = c["n"], c["k"]
        away = F.greatest(F.lit(0.7), k * LETTER_COINCIDENCE - 1.0) * n
        p_chi = _normal_cdf((c["chi"] - (k - 1.0 + away)) / F.sqrt((k - 1.0 + away * 2.0) * 2.0))
        both = c["high"] * (n - c["high"]) * 2.0
        # circular runs have mean 2ab/(n-1) and variance about that of the linear test
        spread = F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1.0)), F.lit(1e-9)))
        z_runs = F.when(both > n, F.abs(c["turns"] - both / (n - 1.0)) / spread).otherwise(F.lit(1e9))
        vary = n * c["sxx"] - c["sx"] * c["sx"]
        z_serial = F.when(
            vary > 0, F.abs((n * c["sxy"] - c["sx"] * c["sx"]) / vary + F.lit(1.0) / (n - 1.0)) * F.sqrt(n)
        ).otherwise(F.lit(1e9))
        margin = F.sqrt(n) * MARGIN
        cut = lambda z: F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))
        p = F.greatest(p_chi, _normal_cdf(cut(z_runs - margin)), _normal_cdf(cut(z_serial - margin)), F.lit(1e-30))
        band = reduce(lambda acc, b: F.when(n >= b, F.lit(b)).otherwise(acc), BANDS[1:], F.lit(BANDS[0]))
        step = F.floor(-F.log10(p) * STEPS).cast("int")
        uniform = (z_runs < FAR) & (z_serial < FAR) & (c["chi"] - (k - 1.0) < F.sqrt((k - 1.0) * 2.0) * FAR)
        usual = (n - 1.0) * (n - 2.0) / (k * k * 2.0)  # repeated pairs among uniform letters
        uniform = uniform & (c["again"] <= usual + F.sqrt(usual) * 1.5 + 0.5)
        ratio = F.when(uniform, F.least(F.floor((c["written"] - n * F.log2(k)) * math.log10(2) * STEPS), F.lit(3000))).otherwise(F.lit(0))
        twice = math.ceil(math.log10(2) * STEPS)
        return F.struct(
            c["s"].alias("s"),
            c["e"].alias("e"),
            F.concat_ws("/", c["enc"], band.cast("string")).alias("stratum"),
            step.alias("step"),
            (F.greatest(step, ratio.cast("int"), F.lit(twice)) - twice).alias("best"),
        )

    return F.transform(summed, tested)


def discovery_steps(tests: DataFrame, fdr: float) -> dict[str, int]:
    """The least step that Benjamini-Hochberg accepts, for each stratum that has discoveries.

    tests: (stratum, step), one row a token. Only counts per stratum and step are shuffled, and
    both are bounded (13 encodings by 4 bands by 3,001 steps), as is the result.
    """
    counts = tests.groupBy("stratum", "step").agg(F.count("*").alias("n"))
    every = Window.partitionBy("stratum")
    best = every.orderBy(F.col("step").desc())
    ranked = counts.select("stratum", "step", F.sum("n").over(best).alias("rank"), F.sum("n").over(every).alias("m"))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= F.col("rank") * fdr / F.col("m"))
    return {r[0]: r[1] for r in passed.groupBy("stratum").agg(F.min("step")).collect()}


def candidates(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep`, the fixed patterns' spans `_base` and the battery's `_tests` of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select(*keep, text.alias("_t")).select(
        *keep,
        "_t",
        F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(0)).alias("_assign"),
        F.regexp_extract_all("_t", F.lit(HEX), F.lit(0)).alias("_hex"),
        F.when(F.col("_t").contains("AKIA"), F.regexp_extract_all("_t", F.lit(ACCESS), F.lit(0)))
        .otherwise(F.expr("cast(array() as array<string>)"))
        .alias("_access"),
        F.regexp_extract_all("_t", F.lit(TOKEN), F.lit(0)).alias("_token"),
    )
    long_enough = F.transform("_assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6)
    assign = F.filter(
        F.zip_with(
            _spans(F.col("_t"), ASSIGN, F.col("_assign")), long_enough, lambda x, ok: F.struct(x["s"], x["e"], ok.alias("ok"))
        ),
        lambda x: x["ok"],
    )

    found = raw.select(
        *keep,
        F.concat(
            _kind(assign, 0),
            _kind(_spans(F.col("_t"), ACCESS, F.col("_access")), 1),
            _kind(_spans(F.col("_t"), HEX, F.col("_hex")), 2),
        ).alias("_base"),
        F.zip_with(
            _spans(F.col("_t"), TOKEN, F.col("_token")),
            F.col("_token"),
            lambda x, t: F.struct(x["s"].alias("s"), x["e"].alias("e"), t.alias("token")),
        ).alias("_token"),
    )
    fresh = F.filter("_token", lambda t: ~F.exists("_base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    found = found.select(*keep, F.array_sort("_base").alias("_base"), fresh.alias("_token"))
    none = F.expr("cast(array() as array<struct<s:int,e:int,stratum:string,step:int,best:int>>)")
    return found.select(
        *keep, "_base", F.when(F.size("_token") > 0, randomness(F.col("_token"))).otherwise(none).alias("_tests")
    )


def _kind(spans: Column, rank: int) -> Column:
    return F.transform(
        spans,
        lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(KINDS[rank]).alias("kind")),
    )


def scan(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), fdr: float = ALPHA, hold: Callable[[DataFrame], DataFrame] = checkpoint
) -> DataFrame:
    """The columns `keep` and `found`: array<struct<s, rank, e, kind>>, sorted, for every row.

    Reads `text` (null: empty). Fixed patterns give the kinds assign, access and hex; the battery
    adds `random` for tokens that overlap none of those. Rows that repeat are scanned as separate
    rows; empty tables give empty results; other columns are ignored. There is no shuffle but that
    of the battery's counts. Each text is scanned once: `hold` keeps the rows with their candidates between the
    counts and the decisions.
    """
    found = hold(candidates(docs, keep))
    steps = discovery_steps(found.select(F.explode("_tests").alias("t")).select("t.stratum", F.col("t.best").alias("step")), fdr)
    if steps:
        least = F.create_map(*[F.lit(x) for pair in sorted(steps.items()) for x in pair])
        random = F.filter("_tests", lambda t: F.coalesce(t["best"] >= F.try_element_at(least, t["stratum"]), F.lit(False)))
    else:
        random = F.filter("_tests", lambda t: F.lit(False))
    return found.select(*keep, F.array_sort(F.concat("_base", _kind(random, 3))).alias("found"))


def written(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", fdr: float = ALPHA) -> DataFrame:
    """`docs` with every secret's span, overlapping ones merged, replaced by `mark`; n_chars follows.

    The spans are kept beside the rows in the shared folder, found once and cut in the same row, so rows need no
    key and texts aren't shuffled. Null texts stay null, and a row without secrets stays as it is. Columns of any
    name are kept; n_chars may be missing. Rows that repeat are cut each; an empty table gives an empty result.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    found = scan(rows, ("row",), fdr, lambda df: stored(df, "secrets")).withColumn("text", F.col("row.text"))
    # merged spans, then the pieces between them
    merged = F.aggregate(
        "found",
        F.expr("cast(array() as array<struct<s:int,e:int>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["s"] <= F.element_at(acc, -1)["e"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )
    starts = F.concat(F.array(F.lit(0)), F.transform("_cuts", lambda x: x["e"]))
    ends = F.concat(F.transform("_cuts", lambda x: x["s"]), F.array(F.length("text")))
    pieces = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    clean = F.array_join(F.transform(pieces, lambda p: F.substring(F.col("text"), p["s"] + 1, p["e"] - p["s"])), mark)
    out = found.withColumn("_cuts", merged).withColumn(
        "_clean", F.when((F.size("found") > 0) & F.col("text").isNotNull(), clean).otherwise(F.col("text"))
    )
    def cut(name: str) -> Column:
        if name == "text":
            return F.col("_clean")
        if name == "n_chars":
            chars = F.length("_clean").cast(docs.schema[name].dataType)
            return F.when(F.size("found") > 0, chars).otherwise(F.col("row.n_chars"))
        return F.col(f"row.`{name}`")

    return out.select(*[cut(c).alias(c) for c in columns])


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["rank"] < 3)
    count = lambda rank: F.size(F.filter("found", lambda x: x["rank"] == rank)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
        count(3).alias("n_random"),
    )
