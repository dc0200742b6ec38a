"""Licenses named in running text, by the phrases of a list."""

from bomspark.operators import text as T

LIST = [
    ("Apache-2.0", "Apache License 2.0"), ("MIT", "MIT License"), ("ISC", "ISC License"), ("GPL-3.0-only", "GNU General Public License v3.0 only"),
    ("GPL-3.0-or-later", "GNU General Public License v3.0 or later"), ("LGPL-2.1-only", "GNU Lesser General Public License v2.1 only"),
    ("MPL-2.0", "Mozilla Public License 2.0"), ("BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License'), ("X-1", None), (None, "Nobody License"),
]
SAID = {
    "Licensed under the Apache License, Version 2.0 (the License)": {"Apache-2.0"},
    "SPDX-License-Identifier: Apache-2.0": {"Apache-2.0"},
    "SPDX-License-Identifier: MIT": {"MIT"}, "license: ISC": {"ISC"}, "the MIT licence": {"MIT"}, "a lecture at MIT on Fair use": set(),
    "under GPLv3, or LGPL-2.1": {"GPL-3.0-only", "LGPL-2.1-only"}, "GPL v3": {"GPL-3.0-only"}, "GPL-3.0": {"GPL-3.0-only"},
    "the GNU General Public License, version 3 or later": {"GPL-3.0-or-later"}, "GNU General Public License\nversion 3.": {"GPL-3.0-only"},
    "mpl 2.0 and the Mozilla Public License, v. 2.0": {"MPL-2.0"}, "BSD license": {"BSD"}, "BSD-3-Clause": {"BSD-3-Clause"}, "the new BSD license": {"BSD-3-Clause", "BSD"},
    "Nobody License": set(), "X-1": {"X-1"}, "the license": set(), "": set(), "word " * 200_000 + "ISC License": {"ISC"},
}


def test_ids_names_and_short_forms(spark):
    rows = [(i, t) for i, t in enumerate(SAID)] + [(99, None), (0, list(SAID)[0])]
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS license_id", "1 AS phrase")
    got = T.observe_listed_licenses(texts, spark.createDataFrame(LIST, "license_id string, name string")).collect()
    for i, (text, want) in enumerate(SAID.items()):
        assert {r.license_id for r in got if r.doc_id == i} == want, text[:60]
    assert len(got) == sum(map(len, SAID.values()))


def test_empty_list_and_texts(spark):
    none = spark.createDataFrame([], "license_id string, name string")
    texts = spark.createDataFrame([(1, "GPLv3 and the MIT License")], "doc_id long, text string")
    assert T.observe_listed_licenses(texts, none, [("MIT", "MIT License")]).count() == 1
    assert T.observe_listed_licenses(texts.limit(0), none).count() == 0


def test_a_phrase_belongs_to_one_license(spark):
    got = {r.phrase: r.license_id for r in T.license_phrases(spark.createDataFrame(LIST + [("GPL-3.0", "GNU General Public License v3.0 only")], "license_id string, name string")).collect()}
    assert got["gpl 3 0"] == "GPL-3.0" and got["gpl 3 0 only"] == "GPL-3.0-only" and "license" not in got and "mit" not in got
