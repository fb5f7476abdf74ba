"""Licence scan against a brute-force search, and expressions by hand."""

import re

import pytest

from tidemark.llm import licenses

TEXTS = ["MIT License", "the mit-license MIT LICENSE mit license apache", "Apache\nLicense, Version 2.0 general public license",
         "Lesser General Public License", "permit license", "mit éé license", "mit licensé", "", None, "x " * 50_000 + "MIT license",
         "Gnu general public general public license", "mit license mit license", "mit_license", "K mit license", "MIT\x00License 12"]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("text", TEXTS)
def test_base_matches_brute_force(text):
    got = licenses.scanner()(text)
    assert got[:5] == brute(text)
    assert set(filter(None, got[4].split(","))) <= set(filter(None, got[5].split(","))) and 0 <= got[8] <= 1


@pytest.mark.parametrize("source, labels, bound, shown", [
    ("MIT", "mit", "mit", "MIT"),
    ("GPL-3.0-or-later OR MIT", "gpl,mit", "mit", "GPL-3.0-or-later OR MIT"),
    ("MIT AND (Apache-2.0 OR GPL-2.0)", "apache,gpl,mit", "apache,mit", "MIT AND (Apache-2.0 OR GPL-2.0)"),
    ("MIT OR Apache-2.0 AND BSD-3-Clause", "apache,bsd,mit", "mit", "MIT OR Apache-2.0 AND BSD-3-Clause"),
    ("GPL-2.0-only WITH Classpath-exception-2.0. More", "gpl", "gpl", "GPL-2.0-only WITH Classpath-exception-2.0"),
    ("Unknown-1.0 OR MIT", "mit", "mit", "Unknown-1.0 OR MIT"),
    ("Unknown-1.0 AND MIT", "", "", ""),
    ("(MIT", "", "", ""),
    ("", "", "", ""),
])
def test_tags(source, labels, bound, shown):
    got = licenses.scanner()(f"// SPDX-License-Identifier: {source}\nint x;")
    assert (got[5], got[6], got[7]) == (labels, bound, shown)


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "MIT License", "a"), (1, "MIT License", "a"), (None, None, None)],
                                 "doc_id long, text string, labels string")
    got = docs.select("doc_id", licenses.scan_udf()("text").alias("m")).collect()
    assert sorted((r.m.n_base, r.m.labels) for r in got) == [(0, ""), (1, "mit"), (1, "mit")]
