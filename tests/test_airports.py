"""Airport lists and display codes, by hand and by brute force."""

import pytest

from roadloom.plans import airports, catalog

DATA = "/root/testdata/sf0.001"
LINES = "doc long, n long, line string"
NAMES = "registry long, place long, name string"


def listed(spark, *texts):
    rows = [(doc, n, line) for doc, text in enumerate(texts) for n, line in enumerate(text)]
    found = airports.airport_list(spark.createDataFrame(rows, LINES)).collect()
    return [(r.doc, r.name, r.code, r.icao, r.iata, r.city, r.status, round(r.lon, 4), round(r.lat, 4)) for r in sorted(found, key=lambda r: (r.doc, r.lat))]


def test_fields_between_name_and_coordinates(spark):
    text = [
        "Domestic Airports", "Airport name", None, "Hill  Top (Old) International Airport [12]", "", "Lake town", "North", "vnab", "VNAC", "NAN", "HTP", "10°30'00\"N 80°15'36\"W",
        "Not in operation Airports", "First Airport", "Second Airport", "20 S 5 E", "Far Airport", *[f"x{k}y" for k in range(17)], "30 N 6 E",
        "In operation Airports", "Near Airport", *[f"x{k}y" for k in range(16)], "31 N 1 N 7 E",
    ]
    assert listed(spark, text) == [
        (0, "First Airport", "FIR", "", "", "Second Airport", "Not in operation", 5.0, -20.0),
        (0, "Near Airport", "NEA", "", "", "x0y", "In operation", 7.0, 1.0),
        (0, "Hill Top (Old) International Airport", "HTP", "VNAB", "HTP", "Lake town", "In operation", -80.26, 10.5),
    ]


def test_documents_do_not_mix_and_may_be_empty(spark):
    assert listed(spark, ["Not in operation Airports", "A Airport"], ["1 N 2 E", "The Airport", "3 N 4 E"], ["", None]) == [(1, "The Airport", "AIR", "", "", "", "In operation", 4.0, 3.0)]
    assert airports.airport_list(spark.createDataFrame([], LINES)).collect() == []


def test_codes_are_unique_in_order(spark):
    names = ["Kat a", "kat b", None, "", "K!", *(f"kat{k}" for k in range(40)), "KAA", "kaz", "Ö"]
    rows = [(reg, -k, x) for reg in (1, 2) for k, x in enumerate(names[reg:])]
    found = airports.display_codes(spark.createDataFrame(rows, NAMES)).collect()
    for reg in (1, 2):
        used = []
        for x in reversed([x or "" for x in names[reg:]]):
            base = ("".join(c for c in x.upper() if c.isascii() and c.isalnum()) or "AIR")[:3].ljust(3, "X")
            k = 0
            code = base
            while code in used:
                code = base[:2] + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[k] if k < 26 else (base[0] + str(k - 25).zfill(2))[-3:]
                k += 1
            used.append(code)
        assert sorted(r.code for r in found if r.registry == reg) == sorted(used) and len(set(used)) == len(used)
    assert airports.display_codes(spark.createDataFrame([], NAMES)).collect() == []
    with pytest.raises(Exception, match="no code is left"):
        airports.display_codes(spark.range(1100).selectExpr("1L AS registry", "id AS place", "'x' AS name")).collect()


def test_registered_codes(spark):
    rows = catalog.QUERIES["P18_display_codes"](spark, DATA).collect()
    assert len({r.code for r in rows}) == len(rows) == len({r.name for r in rows}) and all(len(r.code) == 3 for r in rows)
