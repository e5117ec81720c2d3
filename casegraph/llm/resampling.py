"""Importance resampling towards a target distribution, by hashed n-grams. DataFrame operations only.

1. Every text becomes the array of its features' buckets: all runs of one to three words, hashed. The arrays are
   written once, bucket counts of corpus and target are summed with map-side combining (a fixed number of
   buckets, whatever the corpus), and each bucket has a gain, the scaled logarithm of the ratio of its two
   smoothed shares. The gains are one constant array.
2. A document's weight is the sum of its buckets' gains, looked up in that array. Its score adds Gumbel noise, a
   function of seed and id, so the highest scores are a weighted draw without replacement and reruns agree.
3. The k-th of the composite keys (score falling, id rising, null ids last) is found by radix selection: per 16-bit digit
   one distributed count of at most 65,536 bins among the keys that share the digits so far. Leading
   digits that the least and the greatest key share are known without a count, and the search ends as soon as a
   bin is taken whole.
4. Only keys up to the k-th are range-sorted and ranked: a rank is the number of rows in the sorted parts before
   plus the place inside the part. All other rows keep a null rank and are never moved.

Results for odd input: a null or empty text has no words, no features and weight 0; very long texts are read whole; a
null id has the noise of an empty id and loses ties; repeated rows take part, each for itself (rows of one id and score
are drawn up to the exact number and may exchange their ranks); an empty table gives an empty result, an
empty target makes every gain that of a target without features; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.llm.common import id_text, text_of
from casegraph.scratch import materialize, release

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
RUN = 3
SEED = 42
LEAST_WORDS = 20
DRAW_PERCENT = 5
DIGIT_BITS = 16
_LOW = (1 << DIGIT_BITS) - 1
_SIGN = -(1 << 63)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def buckets_of(tokens: Column, buckets: int = BUCKETS, run: int = RUN) -> Column:
    """array<int>: the bucket of every run of one to ``run`` words."""
    def hashed(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    # Runs of n words are the runs of n - 1 words, but for the last one, each with the word that follows it.
    runs, out = tokens, [F.transform(tokens, hashed)]
    for n in range(2, run + 1):
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), count), F.slice(tokens, F.lit(n), count), lambda a, b: F.concat(a, F.lit(" "), b))
        out.append(F.transform(runs, hashed))
    return F.concat(*out)


def bucket_counts(features: DataFrame) -> dict[int, int]:
    """bucket -> number of features; at most as many entries as there are buckets."""
    return {r["b"]: r["n"] for r in features.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    big, small = float(sum(corpus.values())), float(sum(target.values()))
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (big + buckets) / ((corpus.get(b, 0) + 1.0) * (small + buckets))))
        for b in range(buckets)
    ]


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_text(id_col)), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def _digits(key: Column, falling: bool = False) -> list[Column]:
    """Four unsigned digits that sort as the long ``key`` does."""
    flipped = F.bitwise_not(key).bitwiseXOR(F.lit(_SIGN)) if falling else key.bitwiseXOR(F.lit(_SIGN))
    return [F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit(_LOW)).cast("int") for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS)]


def _known(least: int, greatest: int, falling: bool = False) -> list[int | None]:
    """The leading digits that all keys between two share; None from the first that differs."""
    def split(value: int) -> list[int]:
        flipped = ((~value if falling else value) ^ _SIGN) & (2**64 - 1)
        return [flipped >> shift & _LOW for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS)]

    out: list[int | None] = []
    for a, b in zip(split(least), split(greatest), strict=True):
        out.append(a if a == b and None not in out else None)
    return out


def radix_select(keyed: DataFrame, k: int, score_col: str = "score", id_col: str = "id") -> Column:
    """A condition on rows of ``keyed``: the ``k`` first by falling score and rising id, and whatever ties with the last of them.

    ``score`` and ``id`` are longs; null ids come last. ``keyed`` should be a written table.
    """
    span = keyed.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in (score_col, id_col) for n, f in (("least", F.min), ("most", F.max))]).first()
    if k <= 0 or span["n"] == 0:
        return F.lit(False)
    if k >= span["n"]:
        return F.lit(True)
    ids = F.coalesce(F.col(id_col), F.lit(0))
    columns = [*_digits(F.col(score_col), falling=True), F.col(id_col).isNull().cast("int"), *_digits(ids)]
    score_known = _known(span[f"least_{score_col}"], span[f"most_{score_col}"], falling=True)
    prefix, chosen, left = F.lit(True), [], k
    for place, digit in enumerate(columns):
        shared = score_known[place] if place < len(score_known) else None
        if shared is not None:
            chosen.append((digit, shared))
            continue
        counts = sorted((r["d"], r["n"]) for r in keyed.filter(prefix).groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        for value, n in counts:
            if n >= left:
                break
            left -= n
        chosen.append((digit, value))
        prefix = prefix & (digit == value)
        if n == left:  # the whole bin is taken
            break
    # d0 < c0 or (d0 = c0 and (d1 < c1 or ... d_last <= c_last)).
    (digit, value), *earlier = reversed(chosen)
    return reduce(lambda inner, step: (step[0] < step[1]) | ((step[0] == step[1]) & inner), earlier, digit <= value)


def ranked(selected: DataFrame, k: int) -> DataFrame:
    """``selected`` (id, score, row, ...) with rank from 1 by falling score and rising id; null beyond ``k``."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    ordered = selected.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits of the increasing id count a part's rows.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(ordered.select("*", F.spark_partition_id().alias("part"), place.alias("place")), "resampling-ranks")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a part
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    rank = F.col("before") + F.col("place") + 1
    return joined.select(*selected.columns, F.when(rank <= k, rank).alias("rank"))


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = DRAW_PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    run: int = RUN,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (module docstring)."""
    def featured(df: DataFrame, text: str, *kept: Column) -> DataFrame:
        split = df.select(*kept, words(text_of(text)).alias("tokens"))
        return split.select(*[c for c in split.columns if c != "tokens"], F.size("tokens").alias("n_words"), buckets_of(F.col("tokens"), buckets, run).alias("buckets"))

    features = materialize(featured(docs, text_col, F.col(id_col).cast("long").alias("id")), "resampling-features")
    table = gains(bucket_counts(features), bucket_counts(featured(target, target_text_col)), buckets)
    # A text of numbers, split and cast, folds to one constant array; thousands of literals would be thousands of expressions.
    gain = F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.get(gain, b))
    weighted = features.select("id", F.size("buckets").cast("long").alias("n_features"), (F.col("n_words") >= least_words).alias("fit"), weight.alias("weight"))
    scored = weighted.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id())
    keyed = materialize(scored, "resampling-keys")
    release(features)
    fit = keyed.filter("fit")
    k = percent * fit.count() // 100
    drawn = F.col("fit") & radix_select(fit, k)
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    others = keyed.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return others.select(*columns).unionByName(ranked(keyed.filter(drawn), k).select(*columns))
