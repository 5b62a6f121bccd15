"""Airport lists read from plain text, and short display codes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import exprs as E
from roadloom.sources.stored import cut, table

QUERIES, SQL = {}, {}

#: Headings of such a list, the two section headings, words that tell nothing about a place.
HEADINGS = [
    "Airport name", "City served", "Province", "Location", "ICAO", "IATA", "Usage", "Runway(s)", "Coordinates",
    "Total passengers", "Remarks", "District", "Domestic Airports", "Regional Hub Airports",
]
SECTIONS = {"In operation Airports": "In operation", "Not in operation Airports": "Not in operation"}
PLAIN_WORDS = ["airport", "international", "domestic", "the"]
REACH = 17  # lines after a name among which its coordinates are looked for
MAX_CODES = 36**3  # codes of three characters that there are: no registry can have more names


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def name_code(name):
    """Three letters of the first two telling words of a name, or of the only one; AIR if there is none."""
    words = F.split(F.regexp_replace(name, r"\([^)]*\)", ""), "[^A-Za-z0-9]+")
    words = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(PLAIN_WORDS))
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    letters = F.when(second.isNotNull(), F.concat(F.substring(first, 1, 1), F.substring(second, 1, 2))).otherwise(F.substring(first, 1, 3))
    return F.coalesce(F.rpad(F.upper(letters), 3, "X"), F.lit("AIR"))


def airport_list(lines: DataFrame) -> DataFrame:
    """Airports of lists in plain text. lines: doc, n (order of lines), line; one row per airport comes back.

    An airport is a line with the word Airport that is no heading; its coordinates stand in the first line with both
    of them, at most 17 lines (empty ones aside) further; what lies between are its fields. Airports before the
    same coordinates: the first of those near enough. A line with coordinates is no name. Null lines count as
    empty; other columns are left out. Codes: a field of four letters, then one of three behind it (or else
    anywhere), or three letters of the name."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.translate("line", "\u00a0", " ")), r"\[\d+\]", ""), r"\s+", " "))
    at, before = Window.partitionBy("doc").orderBy("n"), Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    s = lines.select("doc", "n", text.alias("text")).where("text <> ''").withColumn("point", E.coordinate_pair(F.col("text")))
    section = F.element_at(F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv]), F.col("text"))
    s = s.select("doc", "text", "point", F.row_number().over(at).alias("i"), F.coalesce(F.last(section, ignorenulls=True).over(before), F.lit("In operation")).alias("status"))
    after = Window.partitionBy("doc").orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("end", F.first(F.when(F.col("point").isNotNull(), F.col("i")), ignorenulls=True).over(after)).where(f"end - i <= {REACH}")
    names = F.col("text").contains("Airport") & ~F.col("text").isin(HEADINGS) & ~F.col("text").endswith("Airports") & F.col("point").isNull()
    s = s.groupBy("doc", "end").agg(
        F.max("point").alias("point"), F.min_by("status", F.when(names, F.col("i"))).alias("status"), F.min(F.when(names, F.col("i"))).alias("head"),
        F.sort_array(F.collect_list(F.when(F.col("point").isNull(), F.struct("i", "text")))).alias("all"),
    ).where("head is not null")
    own = F.filter("all", lambda x: x["i"] >= F.col("head"))
    s = s.select("doc", "head", "status", "point", F.transform(own, lambda x: x["text"]).alias("own"))
    s = s.withColumns({"name": F.get("own", F.lit(0)), "fields": F.slice("own", F.lit(2), F.greatest(F.size("own") - 1, F.lit(0)))})
    letters = lambda a, k: F.filter(F.transform(a, lambda x: F.upper(F.trim(x))), lambda x: x.rlike(f"^[A-Z]{{{k}}}$") & ~x.isin("NAN", "NAA"))
    s = s.withColumn("icao", F.coalesce(F.get(letters(F.col("fields"), 4), F.lit(0)), F.lit("")))
    place = F.array_position("fields", F.col("icao")).cast("int")
    behind = F.when(place > 0, F.get(letters(F.slice("fields", place + 1, F.size("fields")), 3), F.lit(0)))
    s = s.withColumn("iata", F.coalesce(behind, F.get(letters(F.col("fields"), 3), F.lit(0)), F.lit("")))
    part = lambda k: F.coalesce(F.get("fields", F.lit(k)), F.lit(""))
    code = F.when(F.col("iata") != "", F.col("iata")).otherwise(name_code(F.col("name")))
    return s.select("doc", "name", code.alias("code"), "icao", "iata", part(0).alias("city"), part(1).alias("province"), "status", F.col("point.lon").alias("lon"), F.col("point.lat").alias("lat"))


def _codes(rows: pd.DataFrame) -> pd.DataFrame:
    """Codes of one registry in its order: the base, else two of its letters and one more, else one and a number."""
    used, out = set(), []
    for base in rows.sort_values(["place", "name"])["base"]:
        tries = [base, *(base[:2] + chr(65 + k) for k in range(26)), *(f"{base[0]}{k:02d}"[-3:] for k in range(1, 1000))]
        code = next((t for t in tries if t not in used), None)
        if code is None:
            raise ValueError(f"no code is left for {base}")
        used.add(code)
        out.append(code)
    return rows.sort_values(["place", "name"]).assign(code=out)[["registry", "name", "code"]]


def display_codes(names: DataFrame) -> DataFrame:
    """registry, name, code: codes of three characters, unique within a registry, given in order of place, then name.

    names: registry, place, name. The codes of a registry depend on each other, so one task gives them. A registry is bounded by
    the number of codes of three characters (`MAX_CODES`): where no code is left for a name, an error is raised. Null names count as empty, and null
    places come last."""
    letters = F.regexp_replace(F.upper(F.coalesce("name", F.lit(""))), "[^A-Z0-9]+", "")
    base = F.rpad(F.substring(F.when(letters == "", "AIR").otherwise(letters), 1, 3), 3, "X")
    rows = names.select("registry", F.col("place").cast("double").alias("place"), F.coalesce("name", F.lit("")).alias("name"), base.alias("base"))
    if rows.groupBy("registry").count().where(f"count > {MAX_CODES}").head(1):
        raise ValueError(f"no code is left: a registry has more than {MAX_CODES} names")
    return rows.groupBy("registry").applyInPandas(_codes, "registry long, name string, code string")


def _lines(spark, d):
    """A list of airports for each region, one per nation, some without codes."""
    k = F.col("n_nationkey")
    letter = lambda c: F.char(65 + c % 26)
    parts = [
        F.when(k % 3 == 0, "Not in operation Airports").otherwise("In operation Airports"), F.lit("Airport name"), F.concat("n_name", F.lit("  Airport [3]")), F.concat(F.lit("City "), k),
        F.concat(F.lit("Province "), k), F.when(k % 4 != 3, F.concat(F.lit("VN"), letter(k), letter(k * 7))), F.when(k % 5 != 4, F.concat(letter(k * 3), F.lit("Q"), letter(k * 11))), F.lit(" "),
        F.format_string("27°%d' %d\" N, 85° %d' E", k, k * 2, k + 20),
    ]
    rows = table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.posexplode(F.array(*parts)).alias("j", "line"))
    return rows.select(F.col("n_regionkey").alias("doc"), (F.col("n_nationkey") * 10 + F.col("j")).alias("n"), "line")


@query("S12_airport_list", """WITH k AS (SELECT n_nationkey AS k, n_regionkey AS doc, n_name, CASE WHEN n_nationkey % 4 <> 3 THEN 'VN' || chr(65 + n_nationkey % 26) || chr(65 + n_nationkey * 7 % 26) ELSE '' END AS icao,
CASE WHEN n_nationkey % 5 <> 4 THEN chr(65 + n_nationkey * 3 % 26) || 'Q' || chr(65 + n_nationkey * 11 % 26) ELSE '' END AS iata FROM nation), w AS (SELECT *, list_filter(regexp_split_to_array(n_name, '[^A-Za-z0-9]+'), lambda x: x <> '') AS w FROM k)
SELECT doc, n_name || ' Airport' AS name, CASE WHEN iata <> '' THEN iata WHEN len(w) > 1 THEN upper(rpad(substr(w[1], 1, 1) || substr(w[2], 1, 2), 3, 'X')) ELSE upper(rpad(substr(w[1], 1, 3), 3, 'X')) END AS code, icao, iata,
'City ' || k AS city, 'Province ' || k AS province, CASE WHEN k % 3 = 0 THEN 'Not in operation' ELSE 'In operation' END AS status, round(85 + (k + 20) / 60, 6) AS lon, round(27 + k / 60 + k * 2 / 3600, 6) AS lat FROM w""")
def s12(spark, d):
    return airport_list(_lines(spark, d)).withColumns({c: F.round(c, 6) for c in ("lon", "lat")})


@query("P18_display_codes")
def p18(spark, d):
    """Codes of nations, brands and priorities, in the order of their names; many share a base."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    for t, c in (("part", "p_brand"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment"), ("region", "r_name")):
        names = names.union(table(spark, d, t).select(c))
    return display_codes(cut(names.distinct()).select(F.lit(0).cast("long").alias("registry"), F.lit(0).alias("place"), "name"))
