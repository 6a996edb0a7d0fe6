"""Secret scan: fixed patterns, and a randomness test battery for whatever else looks generated.

Built from SQL functions only. Base spans are the leftmost non-overlapping matches of three patterns. The
battery adds spans. Candidates are runs of LEAST or more letters, digits and separators of base64 that lie outside base spans. A run is tested whole if it has the shape of base64: upper and
lower case, digits, and at most one separator in ten characters; of others (paths, slugs and identifiers have more separators) each part of LEAST or more letters and digits is tested by
itself. A candidate's encoding is inferred from its characters, which gives its alphabet, and three statistics say how far it
is from uniform random characters of it: chi-squared over the alphabet, the number of runs above and below the alphabet's middle,
and the lag-1 serial correlation.

A discovery claims randomness, so each test's null hypothesis is structure (an equivalence test), and a candidate's p-value is the largest of the three:

* chi-squared is at least as large as a source with the index of coincidence COINCIDENCE has it: with k symbols it exceeds chance by
  k * COINCIDENCE - 1 for each character (noncentral, normal approximation; its left tail is lighter, so the p-value is an upper bound);
* in encodings of both cases that is asked of the letters without their case, as names in CamelCase spread ordinary letters over two alphabets; their evidence is joined with that of
  how often capitals, small letters and digits take turns, which in ordinary names is at most CHANGES of all places (the sum of both deviations, over the root of two);
* runs and serial correlation are at least STRAY standard deviations a square root of length off, as in padded, repeated or ascending strings.

Short strings can't reject. False discoveries over the whole corpus are held to ALPHA by Benjamini and Hochberg's rule on p-values weighted by length
(longer candidates weigh more, weights average 1), on counts in BINS bins of log p rather than on a total order.

Positions are code points, ends exclusive. Defined cases: null counts as empty; empty texts give no
spans, and the hash of an empty list. Texts of any length are searched whole. Repeated rows give repeated results. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

# Kinds and patterns, in the order in which spans are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LEAST = 20
PLAIN = rf"[A-Za-z0-9]{{{LEAST},}}"
# What a base span covers, and runs of key characters that don't reach into it.
COVERED = r"""(?:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,})"""
RUN = rf"{COVERED}|(?=[A-Za-z0-9][A-Za-z0-9+/_=-]{{{LEAST - 1}}})(?!{COVERED})[A-Za-z0-9](?:(?!{COVERED})[A-Za-z0-9+/_=-]){{{LEAST - 1},}}+"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The index of coincidence (the sum of squared symbol frequencies) of ordinary strings: of English letters; of numbers and dates, where few digits prevail.
LETTERS, NUMBERS = 0.065, 0.16
# Name, pattern, alphabet, index of coincidence; the first that matches counts.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", _DIGITS, NUMBERS),
    ("hex", r"^[0-9a-f]+$", _DIGITS + _LOWER[:6], NUMBERS),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + _UPPER[:6], NUMBERS),
    ("lower", r"^[a-z]+$", _LOWER, LETTERS),
    ("upper", r"^[A-Z]+$", _UPPER, LETTERS),
    ("base32", r"^[A-Z2-7]+$", _UPPER + _DIGITS[2:8], LETTERS),
    ("base36", r"^[0-9a-z]+$", _DIGITS + _LOWER, LETTERS),
    ("BASE36", r"^[0-9A-Z]+$", _DIGITS + _UPPER, LETTERS),
    ("letters", r"^[A-Za-z]+$", _UPPER + _LOWER, LETTERS),
    ("base62", r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, LETTERS),
    ("base64", r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/", LETTERS),
    ("base64url", r"", _UPPER + _LOWER + _DIGITS + "-_", LETTERS),
)
MIXED, FOLDED, CHANGES = ("letters", "base62", "base64", "base64url"), 36, 0.42
ALPHA = 0.01
STRAY = 0.8
BINS = 2000
BLOCK = 256


def _let(value: Column, f) -> Column:
    """f(value), with the value worked out once: a column that a lambda only refers to would be worked out for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def with_spans(df: DataFrame, text: str, pattern: str, out: str, keep: str | None = None) -> DataFrame:
    """Add an array of (start, end, match) of all leftmost non-overlapping matches; `keep` is an SQL condition on `s.m`."""
    kind = "array<struct<start:int,end:int,m:string>>"
    at = lambda x: x["gap"] + F.length(x["m"])
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # each match with the length of what lies before it; a fold turns lengths into positions, BLOCK matches at a time, because it copies what it has
    steps = F.filter(F.zip_with(matches, between, lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("m"))), lambda x: x["m"].isNotNull())
    blocks = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda i: F.slice(s, i * BLOCK + 1, BLOCK))
    lengths = lambda b: F.transform(b, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + at(x)))
    fold = lambda block, before: F.aggregate(
        block,
        F.struct(before.alias("at"), F.array().cast(kind).alias("spans")),
        lambda acc, x: F.struct((acc["at"] + at(x)).alias("at"), F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + at(x)).alias("end"), x["m"].alias("m")))).alias("spans")),
        lambda acc: acc["spans"],
    )
    every = lambda b: _let(lengths(b), lambda n: F.flatten(F.transform(b, lambda block, i: fold(block, F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda acc, x: acc + x)))))
    found = _let(steps, lambda s: F.when(F.size(s) > 0, _let(blocks(s), every)).otherwise(F.array().cast(kind)))
    df = df.withColumn(out, F.when(F.col(text).rlike(pattern), found).otherwise(F.array().cast(kind)))
    return df.withColumn(out, F.expr(f"filter({out}, s -> {keep})")) if keep else df


def _normal(z: Column) -> Column:
    """The normal distribution function, to 2e-4."""
    z = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    return 1 / (1 + F.exp(-1.5976 * z - 0.070565 * z * z * z))


def battery(candidates: DataFrame, value: str = "m") -> DataFrame:
    """Add encoding, chi_squared, runs_z, serial_z and p (the evidence against structure) for strings in a column."""
    pick = lambda i: F.coalesce(*[F.when(F.col(value).rlike(e[1]), F.lit(e[i])) for e in ENCODINGS[:-1]], F.lit(ENCODINGS[-1][i]))
    df = candidates.select("*", pick(0).alias("encoding"), pick(2).alias("_alphabet"), (F.length(pick(2)) * pick(3) - 1).alias("_structure"), F.length(value).cast("double").alias("n"), F.split(value, "").alias("_chars"))
    df = df.withColumn("_x", F.expr("transform(_chars, c -> cast(locate(c, _alphabet) as double))"))
    df = df.withColumn("_k", F.length("_alphabet").cast("double"))
    squares = F.expr(f"aggregate(array_distinct(_chars), 0D, (a, c) -> a + pow(n - length(replace({value}, c, '')), 2))")
    df = df.withColumn("chi_squared", F.col("_k") / F.col("n") * squares - F.col("n"))
    extra = F.col("n") * F.col("_structure")
    p_chi = _normal((F.col("chi_squared") - (F.col("_k") - 1 + extra)) / F.sqrt(2 * (F.col("_k") - 1 + 2 * extra)))
    folded = F.expr(f"aggregate(array_distinct(split(lower({value}), '')), 0D, (a, c) -> a + pow(n - length(replace(lower({value}), c, '')), 2))")
    more = F.col("n") * (FOLDED * LETTERS - 1)
    even = (FOLDED - 1 + more - (FOLDED / F.col("n") * folded - F.col("n"))) / F.sqrt(2 * (FOLDED - 1 + 2 * more))
    turns = F.expr("cast(size(filter(sequence(1, size(_x) - 1), i -> floor((_x[i] - 1) / 26) <> floor((_x[i - 1] - 1) / 26))) as double)")
    turning = (turns - CHANGES * (F.col("n") - 1)) / F.sqrt(CHANGES * (1 - CHANGES) * (F.col("n") - 1))
    p_chi = F.when(F.col("encoding").isin(*MIXED) & (F.col("n") > 1), _normal(-(even + turning) / 2**0.5)).otherwise(p_chi)
    runs = F.expr("1D + size(filter(sequence(1, size(_x) - 1), i -> (_x[i] > (_k + 1) / 2) <> (_x[i - 1] > (_k + 1) / 2)))")
    df = df.withColumn("runs_z", F.when(F.col("n") > 1, (runs - (F.col("n") + 1) / 2) / F.sqrt((F.col("n") - 1) / 4)).otherwise(0.0))
    df = df.withColumn("_mean", F.expr("aggregate(_x, 0D, (a, x) -> a + x) / n"))
    spread = F.expr("aggregate(_x, 0D, (a, x) -> a + pow(x - _mean, 2))")
    lagged = F.expr("aggregate(zip_with(slice(_x, 1, size(_x) - 1), slice(_x, 2, size(_x) - 1), (x, y) -> (x - _mean) * (y - _mean)), 0D, (a, x) -> a + x)")
    df = df.withColumn("serial_z", F.when((F.col("n") > 1) & (spread > 0), lagged / spread * F.sqrt("n")).otherwise(F.sqrt("n")))
    away = lambda z: _normal(F.abs(z) - STRAY * F.sqrt("n"))
    return df.withColumn("p", F.greatest(p_chi, away(F.col("runs_z")), away(F.col("serial_z")))).drop("_alphabet", "_structure", "_chars", "_x", "_k", "_mean")


def discoveries(tested: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The rows that Benjamini and Hochberg's rule keeps, on p-values weighted by length n."""
    weight = F.greatest(F.lit(8.0), F.least(F.lit(128.0), F.col("n")))
    mean = tested.agg(F.avg(weight).alias("_usual"), F.count("*").alias("_all"))
    weighed = tested.crossJoin(F.broadcast(mean))  # one row
    weight = weight / F.col("_usual")
    bin_ = F.least(F.lit(BINS), F.floor(-20 * F.log(F.least(F.lit(1.0), F.col("p") / weight)))).cast("int")
    weighed = weighed.withColumn("_bin", bin_)
    counts = weighed.groupBy("_bin", "_all").agg(F.count("*").alias("_in"))
    rank = F.sum("_in").over(Window.orderBy(F.desc("_bin")))  # at most BINS + 1 rows
    cut = counts.withColumn("_rank", rank).where(F.exp(-F.col("_bin") / 20.0) <= alpha * F.col("_rank") / F.col("_all")).agg(F.min("_bin").alias("_cut"))
    return weighed.crossJoin(F.broadcast(cut)).where("_bin >= _cut").drop("_usual", "_all", "_bin", "_cut")


def secret_scan(docs: DataFrame) -> DataFrame:
    """For every row of `docs` (doc_id, text): doc_id, n_assign, n_access, n_hex, base (kind, start, end) and found (all spans) in order."""
    shared.tune(docs.sparkSession)
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("_row", F.monotonically_increasing_id())
    df = with_spans(df, "text", ASSIGN, "assign", keep=f"length(regexp_extract(s.m, '{_quoted(ASSIGN)}', 2)) >= 12")
    df = with_spans(df, "text", ACCESS, "access", keep="length(s.m) >= 18")
    df = with_spans(df, "text", HEX, "hex")
    df = with_spans(df, "text", RUN, "runs", keep=f"NOT s.m rlike '^{_quoted(COVERED)}'")
    df = df.withColumn("base", F.array_sort(F.concat(*[F.transform(k, _named(i)) for i, k in enumerate(KINDS[:3])])))
    shape = " AND ".join(f"c.m rlike '{x}'" for x in ("[a-z]", "[A-Z]", "[0-9]", "[+/_-]", "^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$"))
    length = lambda array, n: f"aggregate(slice({array}, 1, {n}), 0, (a, x) -> a + length(x))"
    parts = f"""transform(regexp_extract_all(c.m, '{PLAIN}', 0), (x, i) -> struct(c.start + {length(f"split(c.m, '{PLAIN}', -1)", "i + 1")} + {length(f"regexp_extract_all(c.m, '{PLAIN}', 0)", "i")} AS start, x AS m))"""
    whole = f"{shape} AND 10 * length(regexp_replace(c.m, '[A-Za-z0-9]', '')) <= length(c.m)"
    found = f"flatten(transform(runs, c -> CASE WHEN {whole} THEN array(struct(c.start AS start, regexp_replace(c.m, '=+$', '') AS m)) ELSE {parts} END))"
    df = df.withColumn("random", F.expr(f"transform({found}, c -> struct(c.start AS start, c.start + length(c.m) AS end, c.m AS m))"))
    df = shared.settle(df.select("_row", "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], "base", "random"), "secrets")
    candidates = df.select("_row", F.explode("random").alias("c")).select("_row", "c.start", "c.end", "c.m")
    tested = shared.settle(battery(candidates).drop("m"), "battery")
    added = discoveries(tested).groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS) - 1).alias("rank"), "end", F.lit(KINDS[-1]).alias("kind"))).alias("added"))
    out = df.join(added, "_row", "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))).alias("found"))


def _named(i: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), F.lit(KINDS[i]).alias("kind"))


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def spans_text(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans_text("base").cast("binary"), 256).alias("base_sha256"), spans_text("found").alias("spans"))
