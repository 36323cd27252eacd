"""Fixture views: the driver's TPC-H-like tables mapped onto the domain roles.

The driver data carries no weather, coordinates or fires, so each domain table
is a deterministic projection of a driver table (see SURVEY §5.3).  Every view
exists twice: as a Spark DataFrame builder and as SQL text that DuckDB runs in
the oracle check.  Both must produce the same rows.

Nothing here is an operator of the library; the operators live in
``riskframe.operators`` / ``functions`` / ``plans`` and take these views (or
real landed tables with the same columns) as input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

# The five driver event types play five climate variables.
VARIABLE_CATALOG = [
    ("click", "prec"),
    ("error", "racha"),
    ("purchase", "velmedia_10m"),
    ("signup", "velmedia_2m"),
    ("view", "velmedia_6m"),
]
EVENT_TYPES = [code for code, _ in VARIABLE_CATALOG]
VARIABLE_NAMES = [name for _, name in VARIABLE_CATALOG]

WEATHER_COLUMNS = ["prec", "tmax", "tmed", "tmin", "velmedia", "racha", "sol",
                   "presmax", "presmin", "rhum"]


def _pad6(c: Column) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) < 6, F.lpad(s, 6, "0")).otherwise(s)


def _coord(key: Column, mult: int, mod: int, base: float) -> Column:
    return F.lit(base) + ((key * F.lit(mult)) % F.lit(mod)) / F.lit(1000.0)


def _dms(deg: Column, minutes: Column, sec: Column, hemi: Column) -> Column:
    return F.concat(F.lpad(deg.cast("string"), 2, "0"), F.lpad(minutes.cast("string"), 2, "0"),
                    F.lpad(sec.cast("string"), 2, "0"), hemi)


# --------------------------------------------------------------------------- Spark side

def fx_readings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("lectura_id"),
        F.col("user_id").alias("indicativo"),
        F.col("event_type").alias("variable"),
        F.col("ts"),
        F.col("ts").cast("date").alias("fecha"),
        F.col("value").alias("valor"),
    )


def fx_variables(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(VARIABLE_CATALOG, "codi_variable string, nom_variable string")


def fx_daily(spark: SparkSession, d: str) -> DataFrame:
    r = fx_readings(spark, d)
    wide = r.groupBy("fecha", "indicativo").pivot("variable", EVENT_TYPES).agg(F.sum("valor"))
    return wide.withColumns({t: F.round(F.col(t).cast("decimal(38,10)"), 6).cast("double") for t in EVENT_TYPES})


def fx_stations(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("indicativo"),
        F.col("s_name").alias("nombre"),
        F.col("s_nationkey").alias("nation"),
        _coord(k, 7919, 2400, 40.5).alias("latitud"),
        _coord(k, 104729, 3000, 0.2).alias("longitud"),
        F.when(k % 4 == 0, F.lit("2020-06-30").cast("date")).alias("data_fi"),
        _dms(F.lit(40) + k % 3, (k * 7) % 60, (k * 13) % 60, F.lit("N")).alias("lat_dms"),
        _dms(k % 4, (k * 11) % 60, (k * 17) % 60,
             F.when(k % 5 == 0, "W").otherwise("E")).alias("lon_dms"),
    )


def fx_municipalities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    # the zones are the trips' destinations: the whole range of supplier keys
    low, high = table(spark, d, "supplier").agg(F.min("s_suppkey"), F.max("s_suppkey")).first()
    return c.select(
        _pad6(k).alias("codigo_municipio"),
        k.alias("cod_num"),
        F.col("c_name").alias("municipio"),
        F.col("c_nationkey").alias("comarca"),
        _coord(k, 6271, 2400, 40.5).alias("latitud"),
        _coord(k, 3571, 3000, 0.2).alias("longitud"),
        (F.lit(low) + k % F.lit(high - low + 1)).alias("zona"),
    )


def fx_comarcas(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("comarca"),
        F.col("n_name").alias("nom_comarca"),
        F.col("r_name").alias("provincia"),
    )


def fx_incidents(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("incident_id"),
        _pad6(F.col("o_custkey")).alias("codi_municipi"),
        F.col("o_orderdate").cast("date").alias("fecha"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
        .otherwise(F.lit(0.0)).alias("haforestal"),
        F.col("o_orderstatus").alias("estado"),
    )


def fx_trips(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_shipdate").cast("date").alias("fecha"),
        F.col("l_partkey").alias("origen"),
        F.col("l_suppkey").alias("destino"),
        F.col("l_quantity").alias("viajes"),
        F.col("l_extendedprice").alias("viajes_km"),
    )


def fx_weather(spark: SparkSession, d: str) -> DataFrame:
    """Station-day measures (values rounded half-up to 6 decimals, so both
    engines start from identical numbers)."""
    li = table(spark, d, "lineitem")
    r6 = lambda c: F.round(c.cast("decimal(38,10)"), 6).cast("double")
    return li.groupBy(F.col("l_shipdate").cast("date").alias("fecha"),
                      F.col("l_suppkey").alias("indicativo")).agg(
        r6(F.sum("l_discount") * 10).alias("prec"),
        r6(F.max("l_extendedprice") / 1000).alias("tmax"),
        r6(F.avg("l_extendedprice") / 1000).alias("tmed"),
        r6(F.min("l_extendedprice") / 1000).alias("tmin"),
        r6(F.avg("l_quantity")).alias("velmedia"),
        r6(F.max("l_quantity")).alias("racha"),
        r6(F.avg("l_tax") * 100).alias("sol"),
        r6(F.max("l_tax") * 100 + 1000).alias("presmax"),
        r6(F.min("l_tax") * 100 + 1000).alias("presmin"),
        r6(F.avg("l_discount") * 1000).alias("rhum"),
    )


def fx_dirty(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    comma = F.concat(F.when(cents < 0, "-").otherwise(""),
                     (F.abs(cents) / 100).cast("long").cast("string"), F.lit(","),
                     F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))
    point = F.regexp_replace(comma, ",", ".")
    m = k % 7
    raw = (F.when(m == 0, comma).when(m == 1, F.lit(":")).when(m == 2, F.lit("-"))
           .when(m == 3, F.lit("nan")).when(m == 4, F.lit("")).when(m == 5, F.lit(None))
           .otherwise(point))
    return c.select(
        k.alias("id"),
        raw.alias("valor_txt"),
        F.when(k % 5 == 0, F.lit("-")).otherwise(F.concat(F.lit("N"), (k % 4).cast("string")))
        .alias("vulner_txt"),
        F.when(k % 3 == 0, F.date_format(F.lit("2021-03-04").cast("date"), "yyyyMMdd"))
        .when(k % 3 == 1, F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 365).cast("int")), "yyyy-MM-dd"))
        .otherwise(F.lit("not a date")).alias("fecha_txt"),
    )


def fx_scored(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return o.select(
        k.alias("id"),
        label.cast("long").alias("label"),
        ((label * 400 + (k * 7919) % 600) / F.lit(1000.0)).alias("score"),
    )


def fx_altitude(spark: SparkSession, d: str) -> DataFrame:
    """Landed altitude table: every column text (codes keep leading zeros)."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(_pad6(k).alias("Codigo"), F.col("c_name").alias("Municipio"),
                    F.col("c_nationkey").cast("string").alias("Comarca"),
                    ((k * 37) % 1500).cast("string").alias("Altitud"))


def fx_slope(spark: SparkSession, d: str) -> DataFrame:
    """Landed slope table per comarca: decimal-comma text, ':' when missing."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    v = (k * 53) % 1000
    txt = F.concat((v / 10).cast("long").cast("string"), F.lit(","), (v % 10).cast("string"))
    return n.select(k.cast("string").alias("comarca"),
                    F.when(k % 7 == 6, F.lit(":")).otherwise(txt).alias("porcentaje_pendiente_total"))


def fx_risk(spark: SparkSession, d: str) -> DataFrame:
    """Landed risk table per municipality: integer code, categorical text."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("MUNICIPI"),
                    F.when(k % 4 == 0, "SI").otherwise("NO").alias("ALT_RISC"),
                    F.concat(F.lit("P"), (F.col("c_nationkey") % 5).cast("string")).alias("PERILL"),
                    F.when(k % 5 == 0, F.lit("-"))
                    .otherwise(F.concat(F.lit("V"), (F.col("c_nationkey") % 3).cast("string"))).alias("VULNER"))


SPARK_VIEWS = {
    "fx_readings": fx_readings,
    "fx_variables": fx_variables,
    "fx_daily": fx_daily,
    "fx_stations": fx_stations,
    "fx_municipalities": fx_municipalities,
    "fx_comarcas": fx_comarcas,
    "fx_incidents": fx_incidents,
    "fx_trips": fx_trips,
    "fx_weather": fx_weather,
    "fx_dirty": fx_dirty,
    "fx_scored": fx_scored,
    "fx_altitude": fx_altitude,
    "fx_slope": fx_slope,
    "fx_risk": fx_risk,
}


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    return SPARK_VIEWS[name](spark, d)


# --------------------------------------------------------------------------- SQL side

def _pad6_sql(expr: str) -> str:
    return f"(repeat('0', greatest(0, 6 - length(CAST({expr} AS VARCHAR)))) || CAST({expr} AS VARCHAR))"


def _dms_sql(deg: str, minutes: str, sec: str, hemi: str) -> str:
    return (f"lpad(CAST({deg} AS VARCHAR), 2, '0') || lpad(CAST({minutes} AS VARCHAR), 2, '0') || "
            f"lpad(CAST({sec} AS VARCHAR), 2, '0') || {hemi}")


_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in VARIABLE_CATALOG)
_PIVOT = ", ".join(f"CAST(round(CAST(sum(valor) FILTER (WHERE variable = '{t}') AS DECIMAL(38,10)), 6) AS DOUBLE) AS {t}"
                   for t in EVENT_TYPES)

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_readings": ((), """
        SELECT event_id AS lectura_id, user_id AS indicativo, event_type AS variable, ts,
               CAST(ts AS DATE) AS fecha, value AS valor
        FROM events"""),
    "fx_variables": ((), f"""
        SELECT * FROM (VALUES {_VALUES}) AS v(codi_variable, nom_variable)"""),
    "fx_daily": (("fx_readings",), f"""
        SELECT fecha, indicativo, {_PIVOT}
        FROM fx_readings GROUP BY fecha, indicativo"""),
    "fx_stations": ((), f"""
        SELECT s_suppkey AS indicativo, s_name AS nombre, s_nationkey AS nation,
               40.5 + ((s_suppkey * 7919) % 2400) / 1000.0 AS latitud,
               0.2 + ((s_suppkey * 104729) % 3000) / 1000.0 AS longitud,
               CASE WHEN s_suppkey % 4 = 0 THEN DATE '2020-06-30' END AS data_fi,
               {_dms_sql('40 + s_suppkey % 3', '(s_suppkey * 7) % 60', '(s_suppkey * 13) % 60', "'N'")} AS lat_dms,
               {_dms_sql('s_suppkey % 4', '(s_suppkey * 11) % 60', '(s_suppkey * 17) % 60',
                         "CASE WHEN s_suppkey % 5 = 0 THEN 'W' ELSE 'E' END")} AS lon_dms
        FROM supplier"""),
    "fx_municipalities": ((), f"""
        SELECT {_pad6_sql('c_custkey')} AS codigo_municipio, c_custkey AS cod_num,
               c_name AS municipio, c_nationkey AS comarca,
               40.5 + ((c_custkey * 6271) % 2400) / 1000.0 AS latitud,
               0.2 + ((c_custkey * 3571) % 3000) / 1000.0 AS longitud,
               (SELECT min(s_suppkey) FROM supplier)
               + c_custkey % (SELECT max(s_suppkey) - min(s_suppkey) + 1 FROM supplier) AS zona
        FROM customer"""),
    "fx_comarcas": ((), """
        SELECT n_nationkey AS comarca, n_name AS nom_comarca, r_name AS provincia
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "fx_incidents": ((), f"""
        SELECT o_orderkey AS incident_id, {_pad6_sql('o_custkey')} AS codi_municipi,
               CAST(o_orderdate AS DATE) AS fecha,
               CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS haforestal,
               o_orderstatus AS estado
        FROM orders"""),
    "fx_trips": ((), """
        SELECT CAST(l_shipdate AS DATE) AS fecha, l_partkey AS origen, l_suppkey AS destino,
               l_quantity AS viajes, l_extendedprice AS viajes_km
        FROM lineitem"""),
    "fx_weather": ((), """
        SELECT CAST(l_shipdate AS DATE) AS fecha, l_suppkey AS indicativo,
               CAST(round(CAST(sum(l_discount) * 10 AS DECIMAL(38,10)), 6) AS DOUBLE) AS prec, CAST(round(CAST(max(l_extendedprice) / 1000 AS DECIMAL(38,10)), 6) AS DOUBLE) AS tmax,
               CAST(round(CAST(avg(l_extendedprice) / 1000 AS DECIMAL(38,10)), 6) AS DOUBLE) AS tmed, CAST(round(CAST(min(l_extendedprice) / 1000 AS DECIMAL(38,10)), 6) AS DOUBLE) AS tmin,
               CAST(round(CAST(avg(l_quantity) AS DECIMAL(38,10)), 6) AS DOUBLE) AS velmedia, CAST(round(CAST(max(l_quantity) AS DECIMAL(38,10)), 6) AS DOUBLE) AS racha,
               CAST(round(CAST(avg(l_tax) * 100 AS DECIMAL(38,10)), 6) AS DOUBLE) AS sol,
               CAST(round(CAST(max(l_tax) * 100 + 1000 AS DECIMAL(38,10)), 6) AS DOUBLE) AS presmax, CAST(round(CAST(min(l_tax) * 100 + 1000 AS DECIMAL(38,10)), 6) AS DOUBLE) AS presmin,
               CAST(round(CAST(avg(l_discount) * 1000 AS DECIMAL(38,10)), 6) AS DOUBLE) AS rhum
        FROM lineitem GROUP BY CAST(l_shipdate AS DATE), l_suppkey"""),
    "fx_dirty": ((), """
        SELECT c_custkey AS id,
               CASE c_custkey % 7
                 WHEN 0 THEN comma WHEN 1 THEN ':' WHEN 2 THEN '-' WHEN 3 THEN 'nan'
                 WHEN 4 THEN '' WHEN 5 THEN NULL ELSE replace(comma, ',', '.') END AS valor_txt,
               CASE WHEN c_custkey % 5 = 0 THEN '-' ELSE 'N' || CAST(c_custkey % 4 AS VARCHAR) END
                 AS vulner_txt,
               CASE WHEN c_custkey % 3 = 0 THEN '20210304'
                    WHEN c_custkey % 3 = 1 THEN strftime(DATE '2020-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d')
                    ELSE 'not a date' END AS fecha_txt
        FROM (SELECT c_custkey,
                     (CASE WHEN cents < 0 THEN '-' ELSE '' END) || CAST(abs(cents) // 100 AS VARCHAR)
                       || ',' || lpad(CAST(abs(cents) % 100 AS VARCHAR), 2, '0') AS comma
              FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer))"""),
    "fx_scored": ((), """
        SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS label,
               ((CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 400 + (o_orderkey * 7919) % 600) / 1000.0
                 AS score
        FROM orders"""),
    "fx_altitude": ((), f"""
        SELECT {_pad6_sql('c_custkey')} AS Codigo, c_name AS Municipio,
               CAST(c_nationkey AS VARCHAR) AS Comarca, CAST((c_custkey * 37) % 1500 AS VARCHAR) AS Altitud
        FROM customer"""),
    "fx_slope": ((), """
        SELECT CAST(n_nationkey AS VARCHAR) AS comarca,
               CASE WHEN n_nationkey % 7 = 6 THEN ':'
                    ELSE CAST(((n_nationkey * 53) % 1000) // 10 AS VARCHAR) || ',' ||
                         CAST(((n_nationkey * 53) % 1000) % 10 AS VARCHAR) END AS porcentaje_pendiente_total
        FROM nation"""),
    "fx_risk": ((), """
        SELECT c_custkey AS MUNICIPI, CASE WHEN c_custkey % 4 = 0 THEN 'SI' ELSE 'NO' END AS ALT_RISC,
               'P' || CAST(c_nationkey % 5 AS VARCHAR) AS PERILL,
               CASE WHEN c_custkey % 5 = 0 THEN '-' ELSE 'V' || CAST(c_nationkey % 3 AS VARCHAR) END AS VULNER
        FROM customer"""),
}


def sql_with(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause defining the named fixture views (and their dependencies).

    ``extra`` adds query-specific CTEs (name -> body) after the fixtures.
    """
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for dep in SQL_VIEWS[n][0]:
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({SQL_VIEWS[n][1]})" for n in ordered]
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
