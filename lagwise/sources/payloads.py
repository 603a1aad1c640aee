"""Connector payloads as rows: parsing, catalogs and discovery over landed files. No network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENERGY = "struct<response:struct<total:int,frequency:string,data:array<struct<period:string,value:string>>>>"
CLIMATE = "struct<metadata:struct<resultset:struct<offset:int,count:int,limit:int>>,results:array<struct<date:string,datatype:string,station:string,value:double>>>"
#: The states and the other words that mark a regional title.
STATE_NAMES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia",
    "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland",
    "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey",
    "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina",
    "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming",
)
REGIONAL_WORDS = (" msa", " metro", " county", " district of columbia", " region:", " state:", "(state)")
#: Units of the monthly climate measures.
CLIMATE_UNITS = {"TAVG": "celsius", "TMAX": "celsius", "TMIN": "celsius", "PRCP": "mm", "HTDD": "degree_days", "CLDD": "degree_days"}


def parse_period(text: Column) -> Column:
    """A date from `2024`, `2024-01` or `2024-01-15`; null from anything else."""
    full = F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).when(F.length(text) == 7, F.concat(text, F.lit("-01"))).otherwise(text)
    return F.try_to_date(full, "yyyy-MM-dd")


def energy_rows(payloads: DataFrame) -> DataFrame:
    """variable_id, ts, value of payloads(variable_id, body); null or unreadable cells are skipped."""
    rows = payloads.select("variable_id", F.explode(F.from_json("body", ENERGY)["response"]["data"]).alias("d"))
    return rows.select("variable_id", parse_period(F.col("d.period")).alias("ts"), F.expr("try_cast(d.value as double)").alias("value")).where("ts is not null and value is not null")


def climate_rows(pages: DataFrame) -> DataFrame:
    """variable_id, ts, value of pages(variable_id, body): all that can be read, whichever pages can't."""
    rows = pages.select("variable_id", F.explode(F.from_json("body", CLIMATE)["results"]).alias("d"))
    return rows.select("variable_id", F.try_to_date(F.substring("d.date", 1, 10), "yyyy-MM-dd").alias("ts"), F.col("d.value").alias("value")).where("ts is not null and value is not null")


def climate_chunks(pages: DataFrame, limit: int = 1000) -> DataFrame:
    """variable_id, first_year, pages, rows, complete of pages(variable_id, first_year, page_offset, body).

    A chunk of ten years is complete if its pages follow one another from offset 1 until `limit`
    more would pass the count that they state; a page that can't be read ends it.
    """
    read = pages.select("variable_id", "first_year", "page_offset", F.from_json("body", CLIMATE).alias("b"))
    good = read.where("b.results is not null").select("*", F.size("b.results").alias("n"), F.coalesce("b.metadata.resultset.count", F.lit(0)).alias("total"))
    known = good.groupBy("variable_id", "first_year").agg(F.count("*").alias("pages"), F.sum("n").alias("rows"), F.max("page_offset").alias("last"), F.max("total").alias("total"))
    chunks_ = pages.select("variable_id", "first_year").distinct().join(known, ["variable_id", "first_year"], "left")
    whole = (F.col("last") + limit > F.col("total")) & (F.col("last") == 1 + (F.col("pages") - 1) * limit)
    return chunks_.select("variable_id", "first_year", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce(whole, F.lit(False)).alias("complete"))


def climate_requests(series: DataFrame, first_year: int, last_year: int, size: int = 10) -> DataFrame:
    """variable_id, station_id, datatype, start, end: a request per series and ten years, parsed from `source:STATION_ID_TYPE`."""
    starts = F.sequence(F.lit(first_year), F.lit(last_year), F.lit(size)) if last_year >= first_year else F.array().cast("array<int>")
    key = F.substring_index("variable_id", ":", -1)
    station = F.regexp_replace(F.regexp_extract(key, r"^(.*)_([^_]*)$", 1), "^([^_]*)_", "$1:")
    out = series.select("variable_id", station.alias("station_id"), F.regexp_extract(key, r"^(.*)_([^_]*)$", 2).alias("datatype"), F.explode(starts).alias("year"))
    end = F.least(F.col("year") + size - 1, F.lit(last_year))
    return out.where("station_id <> ''").select("variable_id", "station_id", "datatype", F.make_date("year", F.lit(1), F.lit(1)).alias("start"), F.make_date(end, F.lit(12), F.lit(31)).alias("end"))


def station_catalog(stations: DataFrame, datatypes: tuple[str, ...] = tuple(CLIMATE_UNITS), source: str = "climate", units: dict[str, str] = CLIMATE_UNITS) -> DataFrame:
    """variable_id, name, unit, geo of every station (station_id, name, geo) and datatype."""
    unit = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])
    rows = stations.select("*", F.explode(F.array(*map(F.lit, datatypes))).alias("datatype"))
    key = F.concat(F.lit(source + ":"), F.replace(F.col("station_id"), F.lit(":"), F.lit("_")), F.lit("_"), "datatype")
    return rows.select(key.alias("variable_id"), F.concat_ws(" ", "name", "datatype").alias("name"), F.coalesce(F.try_element_at(unit, F.col("datatype")), F.lit("unknown")).alias("unit"), "geo")


def unpivot_years(wide: DataFrame, keys: list[str], years: list[str]) -> DataFrame:
    """Yearly columns as rows dated 1 January, without empty cells."""
    long = wide.unpivot(keys, years, "year", "value")
    return long.where("value is not null").select(*keys, F.make_date(F.col("year").cast("int"), F.lit(1), F.lit(1)).alias("ts"), "value")


def cross_catalog(left: DataFrame, right: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    """variable_id `source:left_right` of every combination of two code lists (pos, code), in nested order."""
    out = left.select(F.col("pos").alias("p"), F.col("code").alias("l")).join(right.select(F.col("pos").alias("q"), F.col("code").alias("r")))
    out = out.select("p", "q", F.concat(F.lit(source + ":"), "l", F.lit("_"), "r").alias("variable_id")).orderBy("p", "q")
    return out.limit(limit) if limit is not None else out


def chunks(first_year: int, last_year: int, size: int = 10) -> list[tuple[int, int]]:
    return [(y, min(y + size - 1, last_year)) for y in range(first_year, last_year + 1, size)]


def is_regional(title: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a title holds a state's name, one of REGIONAL_WORDS, or one of more (patterns)."""
    words = [w.replace("(", r"\(").replace(")", r"\)") for w in (*STATE_NAMES, *REGIONAL_WORDS)]
    return F.lower(title).rlike("|".join([*words, *more]))


def discover(found: DataFrame, curated: DataFrame, frequencies=("M", "W", "BW", "D"), popularity: int = 10, per_query: int = 10, total: int = 400, queries: DataFrame | None = None) -> DataFrame:
    """New series from search results(query, series_id, title, frequency, popularity).

    Not curated, of a wanted frequency, popular, not regional; the most popular of each query, each
    in the first query that has it. queries(query, pos): their order; without it that of their names.
    """
    fit = found.join(curated, "series_id", "left_anti").where(F.col("frequency").isin(*frequencies) & (F.col("popularity") >= popularity) & ~is_regional(F.col("title")))
    fit = fit.join(queries, "query") if queries is not None else fit.withColumn("pos", F.lit(0))
    first = fit.groupBy("series_id").agg(F.min_by(F.struct("query", "pos", "title", "popularity"), F.struct("pos", "query")).alias("s")).select("series_id", "s.*")
    w = Window.partitionBy("query").orderBy(F.desc("popularity"), "series_id")
    best = first.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= per_query)
    return best.withColumn("title", F.substring("title", 1, 120)).orderBy("pos", "query", "place").drop("pos").limit(total)


def landed_series(catalog: DataFrame, rows: DataFrame, source: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(series, observations) of the first `limit` entries of a curated list (pos, series_id, name, unit, frequency) from landed rows(series_id, ts, value).

    Null and NaN values are dropped; entries without any value have no series.
    """
    wanted = catalog if limit is None else catalog.orderBy("pos").limit(limit)
    key = F.concat(F.lit(source + ":"), "series_id")
    obs = rows.join(wanted.select("series_id"), "series_id", "left_semi").where(F.col("value").isNotNull() & ~F.isnan("value"))
    obs = obs.select(key.alias("variable_id"), F.col("ts").cast("date").alias("ts"), F.col("value").cast("double").alias("value"))
    found = obs.groupBy("variable_id").agg(F.count("*").alias("observations"), F.min("ts").alias("start_date"), F.max("ts").alias("end_date"))
    return wanted.select(key.alias("variable_id"), F.lit(source).alias("source"), "name", "unit", "frequency").join(found, "variable_id"), obs
