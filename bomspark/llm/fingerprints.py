"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a weighted set: its distinct words, each of weight 1 + ln(occurrences).
For every sample a word draws r and c from Gamma(2, 1) and b from U(0, 1), all
functions of the word alone, and has the value

    ln c - r * (floor(ln(weight) / r + b) + 1 - b)

The smallest value of the text is the sample. It is a function of the winning
word and its quantised weight, so two texts agree on a sample with their
generalised Jaccard similarity (sum of smaller weights by sum of larger ones).

A document's successor is found inside buckets of doc_id, whose bounds are
quantiles; texts are dealt once, by bucket, and everything up to the signature
happens in that stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

SAMPLES = 16
#: Buckets for each shuffle partition.
BUCKETS = 4
_SPLIT = r"[\x00-/:-@\[-`{-\x7F]+"


def terms(text: Column) -> Column:
    """Sorted hashes of a text's words (runs of ASCII letters, digits and other
    scripts, in lower case); a text without words is one term."""
    hashes = F.transform(F.split(F.lower(text), _SPLIT), lambda w: F.xxhash64(w))
    words = F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit(""))))
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.xxhash64(text)))


def starts(sorted_terms: Column) -> Column:
    """Positions of the first of each run of equal terms."""
    t = sorted_terms
    return F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))


def sample_value(term: Column, ln_weight: Column, i: int) -> Column:
    """Value of a word in sample ``i``."""
    bits = [F.xxhash64(term, F.lit(3 * i + k)) for k in range(3)]
    high = lambda x: (F.shiftrightunsigned(x, 32) + F.lit(0.5)) * F.lit(2.0**-32)
    low = lambda x: (x.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) * F.lit(2.0**-32)
    r = -F.log(high(bits[0]) * low(bits[0]))
    ln_c = F.log(-F.log(high(bits[1]) * low(bits[1])))
    b = (F.shiftrightunsigned(bits[2], 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return ln_c - r * (F.floor(ln_weight / r + b) + 1 - b)


def signatures(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``signature`` (an int per sample) of each row; keys are unique."""
    t = rows.select(*keys, terms(F.col(text)).alias("_t")).withColumn("_s", starts(F.col("_t")))
    run = F.transform("_s", lambda i, k: F.struct(F.get("_t", i).alias("term"), (F.coalesce(F.get("_s", k + 1), F.size("_t")) - i).alias("n")))
    t = t.select(*keys, F.explode(run).alias("_x")).select(*keys, F.col("_x.term").alias("_term"), F.log(1 + F.log("_x.n")).alias("_w"))
    values = [F.min(sample_value(F.col("_term"), F.col("_w"), i)).alias(f"_v{i}") for i in range(samples)]
    pieces = [F.xxhash64(F.lit(i), F.col(f"_v{i}")).bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(samples)]
    return t.groupBy(*keys).agg(*values).select(*keys, F.array(*pieces).alias("signature"))


def fingerprint(signature: Column) -> Column:
    """Eight hex digits per sample."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(one: Column, two: Column) -> Column:
    """Share of samples on which two signatures agree."""
    same = F.size(F.filter(F.zip_with(one, two, lambda a, b: a == b), lambda x: x))
    return same.cast("double") / F.size(one)


def in_buckets(docs: DataFrame) -> DataFrame:
    """Rows (bucket, id, h, doc_id, text) in buckets that follow each other in
    order of (doc_id, hash of the text). Bounds are quantiles of doc_id; rows of
    a doc_id that fills several buckets are split over them by their hash."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    levels = max(1, math.ceil(math.log2(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    n = 1 << levels
    found = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0]
    bounds = F.array(*[F.lit(int(x)) for x in found]) if found else F.array(*[F.lit(0).cast("long")] * (n - 1))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(levels))])

    def below(than) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(than(F.get(bounds, at + step - 1)), step).otherwise(0))

    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("low", below(lambda b: b < F.col("id"))).withColumn("high", below(lambda b: b <= F.col("id")))
    share = F.floor((F.col("h") * F.lit(2.0**-64) + 0.5) * (F.col("high") - F.col("low") + 1)).cast("int")
    bucket = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.least(F.col("low") + share, F.col("high")))
    return rows.select(bucket.alias("bucket"), "id", "h", "doc_id", "text")


def with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """bucket, key, next_key, doc_id, text and next_text (the text of the next
    document in order of doc_id; after the last the first)."""
    rows = in_buckets(docs)
    order = Window.partitionBy("bucket").orderBy("id", "h")
    inside = rows.select("bucket", "doc_id", "text", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("after"))
    # the first document of each bucket; there are as many as buckets at most
    least = scratch.put(rows.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("k")).select("bucket", "k.id", "k.h"), "first-keys")
    first = rows.join(F.broadcast(least), ["bucket", "id", "h"]).select("bucket", "text").dropDuplicates(["bucket"])
    first = scratch.put(first, "first-texts")
    numbers = sorted(r[0] for r in first.select("bucket").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1], strict=True)), "bucket int, following int")
    first = follows.join(first.select(F.col("bucket").alias("following"), F.col("text").alias("first_text")), "following")
    key = F.shiftleft(F.col("bucket").cast("long"), 40) + F.col("at")
    start = F.shiftleft(F.col("following").cast("long"), 40) + 1
    return inside.join(first, "bucket").select(
        "bucket",
        key.alias("key"),
        F.when(F.col("after").isNull(), start).otherwise(key + 1).alias("next_key"),
        "doc_id",
        "text",
        F.coalesce("after", "first_text").alias("next_text"),
    )


def compare(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next of every row.

    The edited text ends with the first quarter's length of the next document's
    code points instead of its own last quarter. Documents are in order of
    doc_id (null first), those that repeat one in order of a hash of their
    texts. Null texts count as empty. A single document follows itself. Texts
    without words are like equal texts only, empty ones like empty ones. Empty
    tables give no rows; other columns are ignored. Long texts are whole: a row
    holds its text, the edited one and a hash per word."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = with_next(docs, scratch)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left(F.col("text"), n - quarter), F.left(F.col("next_text"), quarter))
    rows = rows.select("bucket", "key", "next_key", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    bodies = F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("body"), F.lit("").alias("sha")),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("body"), F.sha2("edited", 256).alias("sha")),
    )
    own = ["bucket", "key", "next_key", "doc_id", "n_chars"]
    both = rows.select(*own, F.explode(bodies).alias("b")).select(*own, "b.side", "b.sha", "b.body")
    # rows lie by bucket already, so grouping by keys that start with it moves nothing
    sigs = signatures(both, [*own, "side", "sha"], "body", samples)
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("signature")))
    whole = sigs.groupBy(*own).agg(F.max("sha").alias("edited_sha256"), pick(0).alias("signature"), pick(1).alias("edited"))
    whole = scratch.put(whole.drop("bucket"), "signatures")
    following = whole.select(F.col("key").alias("next_key"), F.col("signature").alias("following"))
    return whole.join(following, "next_key").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("signature")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited")).alias("near_edited"),
        likeness(F.col("signature"), F.col("following")).alias("near_next"),
    )
