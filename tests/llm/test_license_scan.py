"""License scan: planted wordings, their variants, and texts that only look alike."""

import pytest

from tickloom.llm.license_scan import TEMPLATES, Scanner, differences, scan_licenses, wording
from tickloom.llm.queries import op5_license_scan

SCHEMA = "doc_id long, text string, license string, begin string"


@pytest.mark.parametrize("i", range(len(TEMPLATES)))
def test_every_template_finds_itself(i):
    scanner = Scanner(TEMPLATES, 0.4, 0.25, 5)
    name, template, gain, missing, added = scanner.match(TEMPLATES[i][1])
    assert (name, template, missing, added) == (TEMPLATES[i][0], i, [], []) and gain > 0.4


def test_differences_are_the_words_that_differ():
    assert differences(wording("Licensed under CC BY 4.0."), wording("(x) licensed, under cc by-nc 4.0 now")) == (["by"], ["by-nc"])
    assert differences(["a"], ["b"]) == (["a"], [])


def test_edge_cases(spark):
    rows = [
        (1, "Intro line\nReleased under the MIT License.\nmore text here", "x", "y"),
        (2, None, None, None), (3, "", "", ""), (None, "Licensed under CC BY-SA 4.0.", "", ""),
        (4, "The licence to fish in this river was granted to nobody at all by the council.", "", ""),
        (5, "word " * 200_000 + "\n\nLicensed under the Apache License,\nVersion 2.0.\n", "", ""),
        (6, "This work is licenced under the GNU General Public License, version 3.", "", ""),
        (7, "All rights reserved.", "", ""), (7, "All rights reserved.", "", ""),
    ]
    got = {}
    result = scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in result:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {1, None, 5, 6, 7}
    assert (got[1][0].license, got[1][0].begin, got[1][0].end, got[1][0].exact) == ("MIT", 11, 42, True)
    assert got[None][0].license == "CC-BY-SA-4.0"
    assert any(r.license == "Apache-2.0" and r.exact for r in got[5])
    assert (got[6][0].license, list(got[6][0].missing), list(got[6][0].added)) == ("GPL-3.0", ["licensed"], ["licenced"])
    assert len(got[7]) == 2
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_finds_all_planted_lines(spark):
    path = "/root/testdata/sf0.01"
    planted = dict(TEMPLATES[i][::-1] for i in (0, 3, 5, 20))
    want = set()
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        want |= {(r.doc_id, planted[line]) for line in (r.text or "").split("\n") if line in planted}
    found = {(r.doc_id, r.license) for r in op5_license_scan(spark, path).filter("exact").collect()}
    assert want and {x for x in found if x[1] in planted.values()} == want


WITHIN = [
    ("Copyright (c) 2021 Example Corporation. All rights reserved.", "Proprietary", 40),
    ("(c) sign 2021 Acme Inc. All rights reserved.", "Proprietary", 24),
    ("This little library was written over many evenings and is now Released under the MIT License.", "MIT", 62),
    ("All texts and pictures in this small collection of mine are Licensed under CC BY-NC 4.0. Enjoy them.", "CC-BY-NC-4.0", 60),
    ("the license of " * 300 + "the rest is Licensed under the Apache License, Version 2.0. " + "and so on " * 300, "Apache-2.0", 4512),
]


@pytest.mark.parametrize("text, license, begin", WITHIN)
def test_wording_within_a_longer_line(spark, text, license, begin):
    got = scan_licenses(spark.createDataFrame([(1, text, "", "")], SCHEMA)).filter("exact").collect()
    assert [(r.license, r.begin) for r in got] == [(license, begin)]


def test_places_within_a_line_keep_their_differences(spark):
    text = "The data are Licensed under the CC BY 4.0, the code is Released under the MIT License, and all the rest: All rights reserved."
    got = scan_licenses(spark.createDataFrame([(1, text, "", "")], SCHEMA)).collect()
    assert [(r.license, list(r.missing), list(r.added)) for r in got] == [("CC-BY-4.0", [], ["the"]), ("MIT", [], []), ("Proprietary", [], [])]
