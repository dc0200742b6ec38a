"""License scans by Dice coefficient over word bigrams.

A document is compared as a whole, by paragraph (between blank lines) and by
line. A unit's bigram set is compared only with templates whose size bounds it
meets: with a Dice of at least t, the larger set has at most (2 - t) / t times
the bigrams of the smaller. DataFrame functions only; no row is moved.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .license_texts import TEMPLATES

SIMILARITY = 0.8


@dataclass(frozen=True)
class Template:
    name: str
    license: str
    text: str

    @property
    def words(self) -> list[str]:
        return re.findall("[a-z0-9]+", self.text.lower())

    @property
    def bigrams(self) -> list[tuple[str, str]]:
        return list(dict.fromkeys(zip(self.words[:-1], self.words[1:], strict=True)))

    def bounds(self, similarity: float) -> tuple[int, int]:
        """Bigrams that a unit has at least and at most."""
        n, share = len(self.bigrams), Fraction(str(similarity))
        return max(1, math.ceil(n * share / (2 - share))), math.floor(n * (2 - share) / share)


STANDARD = tuple(Template(name, license, text) for name, license, text in TEMPLATES)


def _hashed(spark: SparkSession, templates) -> list[list[int]]:
    """Bigram hashes of the templates as Spark computes them; a fixed, small table."""
    rows = spark.createDataFrame([(i, a, b) for i, t in enumerate(templates) for a, b in t.bigrams], "i int, a string, b string")
    got = rows.groupBy("i").agg(F.collect_set(F.xxhash64("a", "b")).alias("h")).collect()
    return [sorted(h) for _, h in sorted(got)]


def units(text: str | Column = "text") -> Column:
    """The whole text, its paragraphs and its lines, equal ones once."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, r"\n")))


def scan(docs: DataFrame, templates=STANDARD, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, license, template and dice of the best
    unit (ties: the greater template name), licenses (those of the best
    template of each unit that reaches ``similarity``, sorted, comma-joined)
    and n_units (units that do). Without any: nulls, empty string and 0.

    Words are runs of ASCII letters and digits in lower case; null and empty
    texts and units of one word match nothing. Equal units of a document count
    once. Rows that repeat are scanned each; other columns are ignored; empty
    tables give no rows."""
    ranges = [t.bounds(similarity) for t in templates]
    least = min((lo for lo, _ in ranges), default=1)
    most = max((hi for _, hi in ranges), default=0)
    table = F.array(
        *(
            F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(len(h)).alias("n"), F.array(*map(F.lit, h)).alias("grams"), F.lit(t.name).alias("template"), F.lit(t.license).alias("license"))
            for t, (lo, hi), h in zip(templates, ranges, _hashed(docs.sparkSession, templates), strict=True)
        )
    )
    words = F.transform(units(), lambda u: F.regexp_extract_all(F.lower(u), F.lit("[a-z0-9]+"), F.lit(0)))
    words = F.filter(words, lambda w: F.size(w) > least)

    def bigrams(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i))))

    grams = F.filter(F.transform(words, bigrams), lambda g: F.size(g).between(least, most))

    def best(g: Column) -> Column:
        fits = F.filter(F.col("templates"), lambda t: F.size(g).between(t["lo"], t["hi"]))
        scored = F.transform(fits, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("dice"), t["template"].alias("template"), t["license"].alias("license")))
        return F.array_max(scored)

    rows = docs.select("doc_id", grams.alias("grams"), table.alias("templates"))
    hits = F.filter(F.transform("grams", best), lambda b: b["dice"] >= similarity)
    rows = rows.select("doc_id", hits.alias("hits")).withColumn("top", F.array_max("hits"))
    return rows.select(
        "doc_id",
        F.col("top.license").alias("license"),
        F.col("top.template").alias("template"),
        F.col("top.dice").alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",").alias("licenses"),
        F.size("hits").cast("long").alias("n_units"),
    )


def oracle(templates=STANDARD, similarity: float = SIMILARITY) -> str:
    """DuckDB SQL for ``scan``; templates carry word pairs instead of hashes."""
    values = ", ".join(
        f"('{t.name}', '{t.license}', {lo}, {hi}, [{', '.join(repr(f'{a} {b}') for a, b in t.bigrams)}])" for t in templates for lo, hi in [t.bounds(similarity)]
    )
    return rf"""
with t(template, license, lo, hi, grams) as (values {values}),
d as (select row_number() over () as i, doc_id, coalesce(text, '') as text from documents),
u as (select i, unnest(list_distinct(list_concat([text], regexp_split_to_array(text, '\n[ \t\r]*\n'), regexp_split_to_array(text, '\n')))) as unit from d),
w as (select row_number() over () as k, i, regexp_extract_all(lower(unit), '[a-z0-9]+') as w from u),
g as (select k, i, list_distinct(list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1])) as g from w where len(w) > 1),
s as (select k, i, 2.0::double * len(list_intersect(g, grams)) / (len(g) + len(grams)) as dice, template, license from g join t on len(g) between lo and hi),
b as (select * from s where dice >= {similarity} qualify row_number() over (partition by k order by dice desc, template desc) = 1),
r as (select i, max({{'dice': dice, 'template': template, 'license': license}}) as top, string_agg(distinct license, ',' order by license) as licenses, count(*) as n from b group by i)
select doc_id, top.license as license, top.template as template, top.dice as dice, coalesce(licenses, '') as licenses, coalesce(n, 0) as n_units from d left join r using (i)
"""
