"""Personal data: fixed patterns, and boosted trees that judge what looser patterns propose.

Built from SQL functions and MLlib's boosted trees. Base spans are the leftmost non-overlapping matches of four patterns that pass a check (parts of an address, check digit, number of digits).

* Generators propose: for each kind a pattern of high recall finds what is written in other ways (`name (at) host dot org`, an address with `[.]`, card numbers with dots, telephone numbers without
  +). Proposals of all kinds may overlap; those that touch a base span are left out.
* Boosted trees score them, from format (lengths, digits, groups, separators, check digit, first and last characters) and context (what stands before and after, and which words).
* They are trained here, on all that was found, spread over the cluster: all different base spans, each rewritten in the ways that generators look for and in its own context, are positive; all
  different proposals of the corpus, and base spans spoilt in the same ways (a wrong check digit, a part over 255, too many digits, no domain), are negative. A proposal of the corpus that has
  the very shape of a rewritten base span may well be personal, and is in neither class. Where a kind has more proposals than base spans, each weighs less, so that together they weigh what its base spans do.
* Thresholds are calibrated on all of a quarter of these, by a hash, that the trees haven't seen: a kind's threshold is the least score that at most ALPHA of its negatives reach,
  counting one more than do. A kind with too few negatives to show that adds nothing, nor does a corpus with under LEAST base spans.
* MLlib itself picks the (at most 31) values at which a feature may be split from some 10,000 rows; gains, trees and leaves come from all rows. It adds up tasks' sums in the order in which they end, so
  of splits that are equally good up to rounding another may be taken in a rerun. Base spans don't depend on that.
* Of chosen proposals that overlap in a chain the one with the best score stays (ties: the longer, then the earlier). It is listed beside the base spans, under its kind.

Positions are code points, ends exclusive. Patterns never try a run of characters again from its middle, and spans are ordered by sorting, so very long texts take time in proportion
to their length (times its logarithm). Defined cases: null counts as empty; empty texts have no spans and the hash of an empty list. Repeated
rows give repeated results, and count once in training. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no run is tried twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# What the generators propose.
_AT = r"(?: ?@ ?| ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:at|AT) )"
_DOT = r"(?:\.| ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) )"
LOOSE = (
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,6}}",
    rf"(?<![0-9.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])",
    r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){11,22}+(?![0-9])",
    r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)|[0-9]{2,5}+)(?:[ ./-]{0,2}[0-9]{2,5}+){1,4}(?![0-9A-Za-z])",
)
_PART = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
BEFORE, AFTER = 24, 12
LEAST = 40
ALPHA = 0.01
_BINS = 1000

_WORDS = {
    "mail": "mail|contact|write|reach|correo|courriel",
    "call": "phone|tel|call|fax|mobil|cell|number|nummer|teléfono",
    "pay": "card|visa|master|amex|credit|pay|kart|carte|tarjeta",
    "host": "\\\\bip|host|addr|server|client|from",
    "code": "version|release|isbn|order|page|token|passw|secret|key|hash|uuid|serial|http|=",
}


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL: whether the check digit of a string of digits is right."""
    value = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"(aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + IF(i % 2 = 0, {value}, {value} * 2 - IF({value} > 4, 9, 0))) % 10 = 0)"


_VALID = f"""CASE g WHEN 0 THEN true WHEN 1 THEN m rlike '^{_PART}([.]{_PART}){{3}}$'
    WHEN 2 THEN length({_digits("m")}) BETWEEN 16 AND 19 AND {luhn(_digits("m"))}
    WHEN 3 THEN length({_digits("m")}) BETWEEN 8 AND 15 ELSE true END"""


def _hits(text: str, pattern: str, g: int) -> Column:
    """All matches, with the number of code points that lie between each and the one before, and what stands on both sides."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    after = F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(1)))
    one = lambda m, i: F.struct(m.alias("m"), i["g"].alias("gap"), i["a"].alias("next"))
    sides = F.zip_with(between, after, lambda g, a: F.struct(g.alias("g"), a.alias("a")))
    found = F.filter(F.zip_with(matches, sides, one), lambda x: x["m"].isNotNull())
    hit = lambda x, i: F.struct(F.lit(g).alias("g"), i.alias("i"), F.length(x["gap"]).alias("gap"), x["m"].alias("m"), F.right(x["gap"], F.lit(BEFORE)).alias("before"), F.left(x["next"], F.lit(AFTER)).alias("after"))
    kind = "array<struct<g:int,i:int,gap:int,m:string,before:string,after:string>>"
    return F.when(F.col(text).rlike(pattern), F.transform(found, hit)).otherwise(F.array()).cast(kind)


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row of `docs` (_row, doc_id), and its base spans (g under 4) and proposals (g - 4 is their kind) outside of these: _row, g, start, end, m, before, after."""
    shared.tune(docs.sparkSession)
    df = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<g:int,i:int,gap:int,m:string,before:string,after:string>>")
    every = [_hits("text", p, g) for g, p in enumerate((EMAIL, IP, CARD, PHONE, *LOOSE))]
    every[0] = F.when(F.contains("text", F.lit("@")), every[0]).otherwise(none)
    every[3] = F.when(F.contains("text", F.lit("+")), every[3]).otherwise(none)
    hits = shared.settle(df.select("_row", "doc_id", F.concat(*every).alias("hits")), "hits")
    # all of a text's matches are sorted in one partition: positions add up, and whether a proposal touches a base span depends on those before and after
    rows = hits.where("size(hits) > 0").select("_row", F.explode("hits").alias("h")).select("_row", "h.*").repartition("_row")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(Window.partitionBy("_row", "g").orderBy("i"))).withColumn("start", F.col("end") - F.length("m")).where(_VALID)
    line, back = (Window.partitionBy("_row").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1) for by in (("start", "g", "i"), (F.desc("start"), F.desc("g"), F.desc("i"))))
    base = lambda c: F.when(F.col("g") < len(KINDS), F.col(c))
    reached, next_ = F.max(base("end")).over(line), F.min(base("start")).over(back)
    rows = rows.withColumn("_free", F.coalesce(reached <= F.col("start"), F.lit(True)) & F.coalesce(next_ >= F.col("end"), F.lit(True))).where(f"_free OR g < {len(KINDS)}")
    kept = rows.select("_row", "g", F.col("start").cast("int"), F.col("end").cast("int"), "m", "before", "after")
    return hits.select("_row", "doc_id"), shared.settle(kept, "spans")


def _variants() -> Column:
    """What is made of a base span (g, m): arrays of (m, label), rewritten (1) and spoilt (0)."""
    d = _digits("m")
    of = lambda *x: "array(" + ", ".join(f"struct({m} AS m, {label} AS label)" for m, label in x) + ")"
    host = "substring_index(m, '@', -1)"
    user = "substring_index(m, '@', 1)"
    four = f"regexp_replace({d}, '([0-9]{{4}})(?=[0-9])', '$1%s')"
    wrong = f"concat(left({d}, length({d}) - 1), (cast(right({d}, 1) as int) + 1 + length({d}) % 8) % 10)"
    local = "regexp_replace(m, '^[+][0-9]{1,3}[ .-]*', '')"
    plain = _digits(local)
    three = f"regexp_replace({plain}, '^([0-9]{{3}})([0-9]{{3}})([0-9]+)$', '$1%s$2%s$3')"
    return F.expr(
        f"""CASE g WHEN 0 THEN {of((f"concat({user}, ' at ', replace({host}, '.', ' dot '))", 1), (f"concat({user}, ' [at] ', replace({host}, '.', ' [dot] '))", 1), (f"concat({user}, '(at)', {host})", 1), (f"concat({user}, ' @ ', {host})", 1),
            (f"concat({user}, '@', substring_index({host}, '.', 1), '. ', substring_index({host}, '.', -1))", 0), ("concat(reverse(substring(translate(m, '.@0123456789', ''), 1, 7)), ' at ', substring_index(m, '.', -1), '.', left(m, 3))", 0), (f"concat(translate({user}, '.0123456789_-', ''), ' at ', {host})", 0))}
        WHEN 1 THEN {of(("replace(m, '.', '[.]')", 1), ("replace(m, '.', ' dot ')", 1), ("replace(m, '.', '(dot)')", 1),
            ("concat('3', right(concat('00', substring_index(m, '.', 1)), 2), '.', substring_index(m, '.', -3))", 0), ("concat('9', right(concat('00', substring_index(m, '.', 1)), 2), replace(concat('.', substring_index(m, '.', -3)), '.', '[.]'))", 0), ("concat(substring_index(m, '.', 3), ' dot 7', right(concat('00', substring_index(m, '.', -1)), 2))", 0))}
        WHEN 2 THEN {of((four % ".", 1), (four % "/", 1), (four % " - ", 1), ((four % ".").replace(d, wrong), 0), (wrong, 0), ((four % " - ").replace(d, wrong), 0))}
        ELSE {of((local, 1), (three % ("-", "-"), 1), (three % (".", "."), 1), (f"concat('00', {d})", 1), (f"concat({plain}, '-', {plain})", 0), (f"concat(left({plain}, 4), '-', substr({plain}, 5, 2), '-', substr({plain}, 7, 2))", 0), (f"concat(left({plain}, 2), '.', substr({plain}, 3, 2), '.', substr({plain}, 5, 4))", 0))} END"""
    )


def features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the numbers that the trees see, for proposals (kind, m, before, after)."""
    d, n = _digits("m"), "cast(length(m) as double)"
    count = lambda pattern: f"cast(length(m) - length(regexp_replace(m, '{pattern}', '')) as double)"
    group = "filter(split(m, '[^0-9]+'), x -> x <> '')"
    kind_of = lambda c: f"CASE WHEN {c} = '' THEN 0D WHEN {c} rlike '[0-9]' THEN 1D WHEN {c} rlike '[a-f]' THEN 2D WHEN {c} rlike '[A-Za-z]' THEN 3D WHEN {c} rlike '[ \\t\\r\\n]' THEN 4D WHEN {c} rlike '[.,;:!?()]' THEN 5D ELSE 6D END"
    near = {
        **{f"kind_{k}": f"cast(kind = {i} as double)" for i, k in enumerate(KINDS)},
        "length": n, "digits": f"cast(length({d}) as double)", "letters": count("[A-Za-z]"), "spaces": count(" "), "dots": count("[.]"), "dashes": count("[-]"), "slashes": count("[/_]"), "brackets": count("[()<>{}]"), "square": count("[\\\\[\\\\]]"),
        "groups": f"cast(size({group}) as double)", "longest_group": f"cast(coalesce(array_max(transform({group}, x -> length(x))), 0) as double)", "shortest_group": f"cast(coalesce(array_min(transform({group}, x -> length(x))), 0) as double)",
        "first_digit": f"cast(coalesce(nullif(left({d}, 1), ''), '-1') as double)", "distinct_digits": f"cast(size(array_distinct(split({d}, ''))) as double)",
        "check_digit": f"cast(length({d}) > 1 AND {luhn(f'left({d}, 24)')} as double)", "largest_part": f"coalesce(array_max(transform({group}, x -> cast(left(x, 9) as double))), 0D)",
        "at_sign": "cast(contains(m, '@') as double)", "dot_words": "cast(size(regexp_extract_all(lower(m), 'dot', 0)) as double)", "user_has_more": "cast(m rlike '^[A-Za-z]*[0-9._%+-]' as double)", "user_length": "cast(length(regexp_extract(m, '^[A-Za-z0-9._%+-]+', 0)) as double)", "end_length": "cast(length(regexp_extract(m, '[A-Za-z0-9]+$', 0)) as double)",
        "char_before": kind_of("right(before, 1)"), "char_after": kind_of("left(after, 1)"), "second_before": kind_of("left(right(before, 2), 1)"), "digits_before": "cast(length(regexp_replace(before, '[^0-9]', '')) as double)", "digits_after": "cast(length(regexp_replace(after, '[^0-9]', '')) as double)",
        **{f"word_{k}": f"cast(lower(before) rlike '{p}' as double)" for k, p in _WORDS.items()},
    }
    return rows.select("*", *[F.expr(e).alias(f"f_{k}") for k, e in near.items()]), [f"f_{k}" for k in near]


def examples(found: DataFrame) -> DataFrame:
    """kind, m, before, after, label, held_out and weight of all labelled examples: what is made of every different base span, and every different proposal."""
    different = found.select("g", "m", "before", "after").distinct().withColumn("_h", F.xxhash64("m", "before", "after"))
    different = shared.settle(different, "different")
    sizes = {r.g: r["count"] for r in different.groupBy("g").count().collect()}  # two for each kind
    shape = F.when(F.col("kind") == 0, F.regexp_replace("m", "[A-Za-z0-9._%+-]+", "a")).otherwise(F.regexp_replace("m", "[0-9]", "9"))
    shape = F.concat_ws(":", "kind", shape)
    made = different.where(F.col("g") < len(KINDS)).withColumn("v", F.explode(_variants())).select(F.col("g").alias("kind"), F.col("v.m").alias("m"), "before", "after", F.col("v.label").alias("label"), "_h", F.lit(1.0).alias("weight"))
    weight = F.element_at(F.array(*[F.lit(min(1.0, max(sizes.get(k, 0), LEAST) / sizes.get(k + len(KINDS), 1))) for k in range(len(KINDS))]), F.col("kind") + 1)
    given = different.where(F.col("g") >= len(KINDS)).select((F.col("g") - len(KINDS)).alias("kind"), "m", "before", "after", F.lit(0).alias("label"), "_h").withColumn("weight", weight)
    known = shared.settle(made.where("label = 1 AND m IS NOT NULL").select(shape.alias("shape")).distinct().withColumn("known", F.lit(True)), "shapes")
    given = shared.matched(given.withColumn("shape", shape), "shape", known, "left").where("known IS NULL").drop("shape", "known")
    rows = made.where("m IS NOT NULL").unionByName(given).select("kind", "m", "before", "after", F.col("label").cast("double"), (F.pmod("_h", F.lit(4)) == 0).alias("held_out"), "weight")
    # dealt and ordered by what they say, so that a rerun trains on the same rows in the same order
    order = ("kind", "m", "before", "after", "label")
    rows, columns = features(rows.repartition(*order[:4]).sortWithinPartitions(*order))
    out = shared.settle(VectorAssembler(inputCols=columns, outputCol="_features").transform(rows).select("kind", "label", "held_out", "weight", "_features"), "labelled")
    shared.discard(different, known)
    return out


class Judge:
    """Boosted trees and each kind's threshold (None: nothing of that kind is chosen)."""

    def __init__(self, model, thresholds: dict[int, float | None]):
        self.model, self.thresholds = model, thresholds

    def scored(self, rows: DataFrame) -> DataFrame:
        """Add `score` (0 to 1) to proposals (kind, m, before, after)."""
        rows, columns = features(rows)
        return _scored(self.model, rows, columns).drop(*columns)

    def chosen(self, rows: DataFrame) -> DataFrame:
        cut = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float("inf") if t is None else t)) for k, t in self.thresholds.items()])
        return self.scored(rows).where(F.col("score") >= cut)


def _scored(model, rows: DataFrame, columns: list[str]) -> DataFrame:
    put = VectorAssembler(inputCols=columns, outputCol="_features").transform(rows)
    return model.transform(put).withColumn("score", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def fit(found: DataFrame, alpha: float = ALPHA, trees: int = 15) -> Judge | None:
    """Train on all that spans() has found; None if there are under LEAST base spans or only one label."""
    labelled = examples(found)
    counts = {(r.label, r.held_out): r["count"] for r in labelled.groupBy("label", "held_out").count().collect()}
    if min((counts.get(x, 0) for x in ((1.0, False), (0.0, False), (1.0, True), (0.0, True))), default=0) < LEAST // 4 or counts[1.0, False] + counts[1.0, True] < LEAST:
        shared.discard(labelled)
        return None
    trainer = GBTClassifier(labelCol="label", featuresCol="_features", weightCol="weight", maxIter=trees, maxDepth=4, stepSize=0.3, minInstancesPerNode=5, checkpointInterval=-1, seed=1)
    model = trainer.fit(labelled.where("NOT held_out"))
    score = F.floor(vector_to_array("probability")[1] * _BINS).cast("int")
    seen = model.transform(labelled.where("held_out AND label = 0")).groupBy("kind", score.alias("bin")).count().collect()  # at most BINS + 1 rows a kind
    thresholds: dict[int, float | None] = {}
    for k in range(len(KINDS)):
        bins = sorted(((r.bin, r["count"]) for r in seen if r.kind == k), reverse=True)
        total, above, cut = sum(n for _, n in bins), 0, _BINS + 1
        for b, n in bins:
            above += n
            if above + 1 > alpha * (total + 1):
                cut = b + 1
                break
        else:
            cut = 0
        thresholds[k] = max(cut, _BINS // 2) / _BINS if 1 <= alpha * (total + 1) and cut <= _BINS else None
    shared.discard(labelled)
    return Judge(model, thresholds)


def personal_data(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """For every row of `docs` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base spans), base and found (all spans: rank, start, end, kind), in order."""
    everyone, found = spans(docs)
    judge = fit(found, alpha)
    own = found.where(F.col("g") < len(KINDS)).select("_row", F.col("g").alias("rank"), "start", "end", F.lit(True).alias("base"))
    if judge:
        chosen = judge.chosen(found.where(F.col("g") >= len(KINDS)).withColumn("kind", F.col("g") - len(KINDS)))
        line = Window.partitionBy("_row").orderBy("start", "end", "kind")
        new = F.coalesce(F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
        chains = chosen.withColumn("_new", new.cast("int")).withColumn("_chain", F.sum("_new").over(line))
        best = chains.groupBy("_row", "_chain").agg(F.max(F.struct("score", (F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("first"), (-F.col("kind")).alias("k"), "start", "end", "kind")).alias("b"))
        own = own.unionByName(best.select("_row", F.col("b.kind").alias("rank"), "b.start", "b.end", F.lit(False).alias("base")))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    span = F.struct("rank", "start", "end", kind.alias("kind"))
    counts = [F.count(F.when(F.col("base") & (F.col("rank") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    lists = own.groupBy("_row").agg(*counts, F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("found"))
    lists = shared.settle(lists, "personal")
    shared.discard(found)
    none = F.array().cast(lists.schema["base"].dataType)
    return everyone.join(lists, "_row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS], F.coalesce("base", none).alias("base"), F.coalesce("found", none).alias("found")
    )


def spans_text(spans_: str) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(spans_text("base").cast("binary"), 256).alias("base_sha256"), spans_text("found").alias("spans"))
