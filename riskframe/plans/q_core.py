"""Registered single-operator queries: sources, sinks, projections, filters,
joins, aggregates, statistics, windows, sorting and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..functions import geo
from ..functions import text as tx
from ..operators import aggregate as agg
from ..operators import relational as rel
from ..operators import series, stats
from ..operators.nearest import pair_count
from ..sources import files as io
from ..streaming import ingest
from . import jobs
from . import sql_jobs as sj
from .catalog import register

W = fx.WEATHER_COLUMNS
r6 = lambda c: tx.round_half_up(c, 6)
s6 = lambda e: sj.rnd(e, 6)
WITH = fx.sql_with

# ============================================================== sources / sinks

STATION_CSV_SCHEMA = T.StructType([
    T.StructField("indicativo", T.LongType()), T.StructField("nombre", T.StringType()),
    T.StructField("latitud", T.DoubleType()), T.StructField("longitud", T.DoubleType()),
    T.StructField("lat_dms", T.StringType())])


@register("csv_roundtrip", WITH("fx_stations") +
          "SELECT indicativo, nombre AS nombre_estacion, latitud, longitud, lat_dms FROM fx_stations")
def q_csv_roundtrip(spark, d):
    """S1/S2/S9/K4/K6: ';' CSV with header written, then re-read with a fixed
    schema, renamed and registered as a view."""
    path = io.scratch_path(spark, "csv")
    io.write_csv(fx.fx_stations(spark, d).select("indicativo", "nombre", "latitud", "longitud", "lat_dms"),
                 path, sep=";", n_files=1)
    return io.load_table(spark, path, STATION_CSV_SCHEMA, sep=";", rename={"nombre": "nombre_estacion"},
                         view="rf_estaciones_csv")


@register("csv_all_string", WITH("fx_altitude") + "SELECT Codigo, Municipio, Comarca, Altitud FROM fx_altitude")
def q_csv_all_string(spark, d):
    """S3: tab-separated, every column read as text (codes keep leading zeros)."""
    path = io.scratch_path(spark, "tsv")
    io.write_csv(fx.fx_altitude(spark, d), path, sep="\t")
    return io.load_table(spark, path, io.all_string_schema(["Codigo", "Municipio", "Comarca", "Altitud"]), sep="\t")


@register("parquet_roundtrip", WITH("fx_weather") + "SELECT * FROM fx_weather")
def q_parquet_roundtrip(spark, d):
    """Parquet overwrite with a file-count cap, read back."""
    path = io.scratch_path(spark, "parquet")
    io.write_parquet(fx.fx_weather(spark, d), path, n_files=2)
    return io.read_parquet(spark, path)


@register("partitioned_roundtrip", WITH("fx_trips") + """
    SELECT fecha, origen, destino, viajes, viajes_km, CAST(year(fecha) AS INTEGER) AS year,
           CAST(month(fecha) AS INTEGER) AS month
    FROM fx_trips WHERE year(fecha) = 1997 AND month(fecha) BETWEEN 3 AND 5""")
def q_partitioned_roundtrip(spark, d):
    """K3: year/month partitioned write; the read filters on the partition
    columns, so only three month folders are scanned (partition pruning)."""
    path = io.scratch_path(spark, "partitioned")
    t = fx.fx_trips(spark, d).withColumns({"year": F.year("fecha"), "month": F.month("fecha")})
    io.write_partitioned(t, path, ["year", "month"])
    back = io.read_parquet(spark, path)
    return back.where((F.col("year") == 1997) & F.col("month").between(3, 5)).select(
        "fecha", "origen", "destino", "viajes", "viajes_km",
        F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"))


TRIP_SCHEMA = T.StructType([T.StructField("fecha", T.DateType()), T.StructField("origen", T.LongType()),
                            T.StructField("destino", T.LongType()), T.StructField("viajes", T.DoubleType()),
                            T.StructField("viajes_km", T.DoubleType())])


@register("file_provenance", WITH("fx_trips") + f"""
    SELECT CAST(year(fecha) AS INTEGER) AS year, CAST(month(fecha) AS INTEGER) AS month, count(*) AS n,
           {s6('sum(viajes)')} AS viajes
    FROM fx_trips GROUP BY year(fecha), month(fecha)""")
def q_file_provenance(spark, d):
    """One read over many monthly '|' files; year and month come from
    the file path, not from the rows."""
    path = io.scratch_path(spark, "provenance")
    t = fx.fx_trips(spark, d).withColumn("mes_archivo", F.date_format("fecha", "yyyyMM"))
    (t.repartition("mes_archivo").write.mode("overwrite").option("header", True).option("sep", "|")
     .partitionBy("mes_archivo").csv(path))
    back = io.read_with_provenance(spark, path, TRIP_SCHEMA, sep="|", date_pattern=r"mes_archivo=(\d{4})(\d{2})")
    return back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("viajes")).alias("viajes"))


@register("events_props_json", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events""")
def q_events_props_json(spark, d):
    """Records landed as JSON lines, re-read with a fixed schema, the
    nested JSON text parsed into a typed column."""
    path = io.scratch_path(spark, "json")
    fx.table(spark, d, "events").select("event_id", "event_type", "props").write.mode("overwrite").json(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
                           T.StructField("props", T.StringType())])
    recs = io.read_json_records(spark, path, schema)
    return io.parse_json_column(recs, "props", "k long").select("event_id", "k", "event_type")


@register("monthly_ingest", WITH("fx_incidents") + f"""
    SELECT strftime(fecha, '%Y-%m') AS periodo, count(*) AS n, {s6('sum(haforestal)')} AS ha
    FROM fx_incidents GROUP BY strftime(fecha, '%Y-%m')""")
def q_monthly_ingest(spark, d):
    """Months ingested in two batches plus a re-run of one month; the
    re-run replaces its partition, so the table holds each month once."""
    path = io.scratch_path(spark, "monthly")
    inc = fx.fx_incidents(spark, d)
    months = [r.periodo for r in ingest.month_range(spark, inc, "fecha").collect()]  # one row per month
    half = len(months) // 2
    ingest.ingest_months(inc, path, "fecha", months[:half])
    ingest.ingest_months(inc, path, "fecha", months[half:])
    if months:
        ingest.ingest_month(inc, path, "fecha", months[0])
    back = spark.read.parquet(path)
    return back.groupBy(F.col("periodo").cast("string").alias("periodo")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("haforestal")).alias("ha"))


@register("monthly_ingest_stream", WITH("fx_incidents") + f"""
    SELECT strftime(fecha, '%Y-%m') AS periodo, count(*) AS n, {s6('sum(haforestal)')} AS ha
    FROM fx_incidents GROUP BY strftime(fecha, '%Y-%m')""")
def q_monthly_ingest_stream(spark, d):
    """S7 as a stream: months land in two batches; after each, an
    ``availableNow`` file-source stream takes only the new files."""
    root = io.scratch_path(spark, "stream")
    landing, out, ckpt = f"{root}/landing", f"{root}/out", f"{root}/_checkpoint"
    inc = ingest.with_month(fx.fx_incidents(spark, d), "fecha")
    cut = inc.agg(F.percentile_approx("fecha", 0.5).alias("m")).first()["m"]  # a split date, not a row cap
    inc.where(F.col("fecha") < F.lit(cut)).write.mode("append").parquet(landing)
    ingest.stream_new_files(spark, landing, inc.schema, out, ckpt)
    inc.where(F.col("fecha") >= F.lit(cut)).write.mode("append").parquet(landing)
    ingest.stream_new_files(spark, landing, inc.schema, out, ckpt)
    back = spark.read.parquet(out)
    return back.groupBy("periodo").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("haforestal")).alias("ha"))


# ============================================================== projections / filters

@register("select_qualified", WITH("fx_weather", "fx_stations") + """
    SELECT l.*, r.nombre AS nombre_estacion, r.latitud AS lat_estacion
    FROM fx_weather l JOIN fx_stations r ON l.indicativo = r.indicativo""")
def q_select_qualified(spark, d):
    return rel.select_qualified(fx.fx_weather(spark, d), fx.fx_stations(spark, d), [("indicativo", "indicativo")],
                                {"nombre": "nombre_estacion", "latitud": "lat_estacion"})


@register("bulk_rename", WITH("fx_stations") + """
    SELECT indicativo AS codi_estacio, nombre AS nom_estacio, latitud AS lat, longitud AS lon FROM fx_stations""")
def q_bulk_rename(spark, d):
    return rel.bulk_rename(fx.fx_stations(spark, d), {"indicativo": "codi_estacio", "nombre": "nom_estacio",
                                                      "latitud": "lat", "longitud": "lon"},
                           keep=["codi_estacio", "nom_estacio", "lat", "lon"])


@register("try_cast_numeric", WITH("fx_altitude") + """
    SELECT Codigo, TRY_CAST(Altitud AS INTEGER) AS Altitud, TRY_CAST(Codigo AS BIGINT) AS codigo_num
    FROM fx_altitude""")
def q_try_cast_numeric(spark, d):
    a = fx.fx_altitude(spark, d).select("Codigo", "Altitud", F.col("Codigo").alias("codigo_num"))
    return rel.try_cast_columns(a, {"Altitud": "int", "codigo_num": "bigint"})


@register("filter_in", WITH("fx_municipalities", "fx_comarcas") + """
    SELECT m.codigo_municipio, c.provincia FROM fx_municipalities m JOIN fx_comarcas c ON m.comarca = c.comarca
    WHERE c.provincia IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')""")
def q_filter_in(spark, d):
    m = fx.fx_municipalities(spark, d).join(fx.fx_comarcas(spark, d), "comarca")
    return rel.filter_in(m, "provincia", ["AFRICA", "AMERICA", "ASIA", "EUROPE"]).select(
        "codigo_municipio", "provincia")


@register("filter_compound", WITH("fx_weather") + "SELECT * FROM fx_weather WHERE prec > 0.5 AND tmax < 50.0")
def q_filter_compound(spark, d):
    return rel.filter_all(fx.fx_weather(spark, d), F.col("prec") > 0.5, F.col("tmax") < 50.0)


@register("filter_nulls", WITH("fx_daily") +
          "SELECT fecha, indicativo FROM fx_daily WHERE click IS NULL AND view IS NOT NULL")
def q_filter_nulls(spark, d):
    d1 = rel.filter_nulls(fx.fx_daily(spark, d), "click", keep_null=True)
    return rel.filter_nulls(d1, "view", keep_null=False).select("fecha", "indicativo")


@register("filter_contains", WITH("fx_municipalities") +
          "SELECT codigo_municipio, municipio FROM fx_municipalities WHERE contains(municipio, '#00000001')")
def q_filter_contains(spark, d):
    return rel.filter_contains(fx.fx_municipalities(spark, d), "municipio", "#00000001").select(
        "codigo_municipio", "municipio")


@register("filter_open_ended", WITH("fx_stations") + "SELECT indicativo, nombre FROM fx_stations WHERE data_fi IS NULL")
def q_filter_open_ended(spark, d):
    return rel.filter_open_ended(fx.fx_stations(spark, d)).select("indicativo", "nombre")


_US = "(hour(ts) * 3600 + minute(ts) * 60) * 1000000 + microsecond(ts)"


@register("noon_snapshot", WITH("fx_readings") + f"""
    SELECT lectura_id, indicativo, variable, ts, fecha, valor FROM (
      SELECT *, row_number() OVER (PARTITION BY indicativo, variable, fecha
                                   ORDER BY abs({_US} - 43200000000), ts, lectura_id) AS rn
      FROM fx_readings) WHERE rn = 1""")
def q_noon_snapshot(spark, d):
    """One reading per station, variable and day: the one nearest noon."""
    return rel.noon_snapshot(fx.fx_readings(spark, d), ["indicativo", "variable"], "ts", tie_col="lectura_id")


@register("filter_date_range", WITH("fx_weather") +
          "SELECT * FROM fx_weather WHERE fecha BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'")
def q_filter_date_range(spark, d):
    return rel.filter_date_range(fx.fx_weather(spark, d), "fecha", "1996-03-01", "1996-05-31")


@register("drop_columns", WITH("fx_weather") + "SELECT * EXCLUDE (sol, presmax, presmin) FROM fx_weather")
def q_drop_columns(spark, d):
    return rel.drop_columns(fx.fx_weather(spark, d), ["sol", "presmax", "presmin"])


@register("having_count", WITH("fx_incidents") + """
    SELECT codi_municipi, fecha, count(*) AS n FROM fx_incidents GROUP BY codi_municipi, fecha HAVING count(*) >= 2""")
def q_having_count(spark, d):
    return rel.having_count(fx.fx_incidents(spark, d), ["codi_municipi", "fecha"], 2)


@register("occurrence_label", WITH("fx_incidents") + """
    SELECT incident_id, CAST(CASE WHEN haforestal > 0 THEN 1 ELSE 0 END AS BIGINT) AS ocurrencia FROM fx_incidents""")
def q_occurrence_label(spark, d):
    return rel.occurrence_label(fx.fx_incidents(spark, d)).select("incident_id", "ocurrencia")


# ============================================================== joins

@register("join_inner", WITH("fx_weather", "fx_stations") + """
    SELECT w.fecha, w.indicativo, w.tmed, s.nombre FROM fx_weather w JOIN fx_stations s ON w.indicativo = s.indicativo""")
def q_join_inner(spark, d):
    return rel.join_keys(fx.fx_weather(spark, d), fx.fx_stations(spark, d), ["indicativo"]).select(
        "fecha", "indicativo", "tmed", "nombre")


@register("sql_join_filter", WITH("fx_municipalities", "fx_comarcas") + """
    SELECT m.codigo_municipio, c.provincia FROM fx_municipalities m JOIN fx_comarcas c ON m.comarca = c.comarca
    WHERE c.provincia IN ('EUROPE', 'ASIA')""")
def q_sql_join_filter(spark, d):
    """The same join written as Spark SQL over registered views."""
    fx.fx_municipalities(spark, d).createOrReplaceTempView("rf_municipios")
    fx.fx_comarcas(spark, d).createOrReplaceTempView("rf_comarcas")
    return spark.sql("""
        SELECT m.codigo_municipio, c.provincia FROM rf_municipios m JOIN rf_comarcas c ON m.comarca = c.comarca
        WHERE c.provincia IN ('EUROPE', 'ASIA')""")


@register("join_left", WITH("fx_municipalities", "fx_incidents") + """
    SELECT m.codigo_municipio, i.n_1995 FROM fx_municipalities m LEFT JOIN (
      SELECT codi_municipi, count(*) AS n_1995 FROM fx_incidents WHERE year(fecha) = 1995 GROUP BY codi_municipi) i
    ON m.codigo_municipio = i.codi_municipi""")
def q_join_left(spark, d):
    inc = (fx.fx_incidents(spark, d).where(F.year("fecha") == 1995)
           .groupBy(F.col("codi_municipi").alias("codigo_municipio")).agg(F.count(F.lit(1)).alias("n_1995")))
    return rel.join_keys(fx.fx_municipalities(spark, d).select("codigo_municipio"), inc, ["codigo_municipio"], "left")


@register("cross_join_count", WITH("fx_municipalities", "fx_stations") + """
    SELECT (SELECT count(*) FROM fx_municipalities) * (SELECT count(*) FROM fx_stations) AS n_pairs,
           (SELECT count(*) FROM fx_municipalities) AS n_left, (SELECT count(*) FROM fx_stations) AS n_right""")
def q_cross_join_count(spark, d):
    """Size of the municipality x station product, without building it."""
    return pair_count(fx.fx_municipalities(spark, d), fx.fx_stations(spark, d))


@register("join_normalized_code", WITH("fx_incidents") + """
    SELECT i.incident_id, c.c_name AS municipio FROM fx_incidents i JOIN (
      SELECT c_name, CAST(c_custkey * 10 + c_custkey % 7 AS VARCHAR) AS ine FROM customer) c
    ON lpad(trim(i.codi_municipi), 6, '0') = lpad(substring(c.ine, 1, length(c.ine) - 1), 6, '0')""")
def q_join_normalized_code(spark, d):
    """6-character text codes against integer codes carrying a check digit."""
    ine = fx.table(spark, d, "customer").select(
        F.col("c_name").alias("municipio"), (F.col("c_custkey") * 10 + F.col("c_custkey") % 7).alias("ine"))
    j = rel.join_normalized(fx.fx_incidents(spark, d), ine, "codi_municipi", "ine", right_drop_check_digit=True)
    return j.select("incident_id", "municipio")


# ============================================================== aggregations

_PIV = ", ".join(f"{s6(f'sum(valor) FILTER (WHERE nom_variable = {chr(39)}{n}{chr(39)})')} AS {n}"
                 for n in fx.VARIABLE_NAMES)


@register("pivot_sum", WITH("fx_readings", "fx_variables") + f"""
    SELECT fecha, indicativo, {_PIV} FROM fx_readings r JOIN fx_variables v ON r.variable = v.codi_variable
    GROUP BY fecha, indicativo""")
def q_pivot_sum(spark, d):
    """A1: long readings pivoted to one column per named variable."""
    p = jobs.climate_pivot(fx.fx_readings(spark, d), fx.fx_variables(spark, d)).drop("velmedia")
    return p.withColumns({n: r6(n) for n in fx.VARIABLE_NAMES})


@register("group_count", WITH("fx_readings") +
          "SELECT indicativo, variable, count(*) AS n FROM fx_readings GROUP BY indicativo, variable")
def q_group_count(spark, d):
    return agg.group_count(fx.fx_readings(spark, d), ["indicativo", "variable"])


@register("group_nonnull_count", WITH("fx_daily") + "SELECT indicativo, count(fecha) AS fecha, " +
          ", ".join(f"count({t}) AS {t}" for t in fx.EVENT_TYPES) + " FROM fx_daily GROUP BY indicativo")
def q_group_nonnull_count(spark, d):
    return agg.group_nonnull_count(fx.fx_daily(spark, d), ["indicativo"])


@register("incidents_by_municipality", WITH("fx_incidents") + f"""
    SELECT codi_municipi, {s6('sum(haforestal)')} AS total, count(*) AS n FROM fx_incidents GROUP BY codi_municipi""")
def q_incidents_by_municipality(spark, d):
    out = agg.group_sum_desc(fx.fx_incidents(spark, d), "codi_municipi", "haforestal")
    return out.withColumn("total", r6("total"))


@register("never_burned", WITH("fx_incidents") + """
    SELECT codi_municipi, sum(haforestal) AS total FROM fx_incidents GROUP BY codi_municipi HAVING sum(haforestal) = 0""")
def q_never_burned(spark, d):
    """A4: municipalities with incidents but no burned area."""
    return agg.groups_by_total(fx.fx_incidents(spark, d), "codi_municipi", "haforestal", zero=True)


@register("burned_at_least_once", WITH("fx_incidents") + """
    SELECT codi_municipi, n FROM (SELECT codi_municipi, sum(ocurrencia) AS n FROM (
      SELECT codi_municipi, CASE WHEN haforestal > 0 THEN 1 ELSE 0 END AS ocurrencia FROM fx_incidents)
      GROUP BY codi_municipi) WHERE n >= 1""")
def q_burned_at_least_once(spark, d):
    lab = rel.occurrence_label(fx.fx_incidents(spark, d))
    return agg.groups_by_total(lab, "codi_municipi", "ocurrencia", zero=False).select(
        "codi_municipi", F.col("total").alias("n"))


@register("row_counts", WITH("fx_weather", "fx_incidents", "fx_trips", "fx_readings") + """
    SELECT 'fx_weather' AS tabla, count(*) AS n_rows FROM fx_weather UNION ALL
    SELECT 'fx_incidents', count(*) FROM fx_incidents UNION ALL
    SELECT 'fx_trips', count(*) FROM fx_trips UNION ALL
    SELECT 'fx_readings', count(*) FROM fx_readings""")
def q_row_counts(spark, d):
    return agg.row_counts({n: fx.view(spark, d, n) for n in ["fx_weather", "fx_incidents", "fx_trips", "fx_readings"]})


@register("distinct_counts", WITH("fx_trips") + """
    SELECT count(DISTINCT fecha) AS n_fecha, count(DISTINCT destino) AS n_destino,
           count(DISTINCT (fecha, destino)) AS n_fecha_destino FROM fx_trips""")
def q_distinct_counts(spark, d):
    return agg.distinct_counts(fx.fx_trips(spark, d), ["fecha", "destino"], [("fecha", "destino")])


@register("value_counts", WITH("fx_incidents") +
          "SELECT estado, count(*) AS n FROM fx_incidents WHERE estado IS NOT NULL GROUP BY estado")
def q_value_counts(spark, d):
    return agg.value_counts(fx.fx_incidents(spark, d), "estado")


@register("column_mode", WITH("fx_dirty") + """
    SELECT vulner_txt AS mode, count(*) AS n FROM fx_dirty WHERE vulner_txt IS NOT NULL
    GROUP BY vulner_txt ORDER BY count(*) DESC, vulner_txt LIMIT 1""")
def q_column_mode(spark, d):
    return agg.column_mode(fx.fx_dirty(spark, d), "vulner_txt")


_DESC = ["prec", "tmax", "tmed", "velmedia", "rhum"]


@register("describe_numeric", WITH("fx_weather") + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS count, {s6(f'avg({c})')} AS mean, {s6(f'stddev_samp({c})')} AS std, "
    f"min({c}) AS min, {s6(f'quantile_cont({c}, 0.25)')} AS q25, {s6(f'quantile_cont({c}, 0.5)')} AS q50, "
    f"{s6(f'quantile_cont({c}, 0.75)')} AS q75, max({c}) AS max FROM fx_weather" for c in _DESC))
def q_describe_numeric(spark, d):
    out = agg.describe_numeric(fx.fx_weather(spark, d), _DESC)
    return out.withColumns({c: r6(c) for c in ["mean", "std", "q25", "q50", "q75"]})


@register("profile_shape", WITH("fx_weather") + "SELECT count(*) AS n_rows, CAST(12 AS BIGINT) AS n_cols FROM fx_weather")
def q_profile_shape(spark, d):
    return agg.profile_shape(fx.fx_weather(spark, d))


@register("null_counts", WITH("fx_daily") + " UNION ALL ".join(
    f"SELECT '{c}' AS columna, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM fx_daily"
    for c in ["fecha", "indicativo"] + fx.EVENT_TYPES))
def q_null_counts(spark, d):
    return agg.null_counts(fx.fx_daily(spark, d))


_IQR = ["tmed", "prec", "velmedia", "rhum"]
_LONG = " UNION ALL ".join(f"SELECT indicativo, fecha, '{c}' AS variable, CAST({c} AS DOUBLE) AS valor FROM fx_weather"
                           for c in _IQR)
_FENCES = {"lf": _LONG,
           "q": "SELECT indicativo, variable, quantile_cont(valor, 0.25) AS q1, quantile_cont(valor, 0.75) AS q3 "
                "FROM lf GROUP BY indicativo, variable",
           "f": "SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q"}


@register("iqr_outliers", WITH("fx_weather", extra=_FENCES) + """
    SELECT lf.indicativo, lf.fecha, lf.variable, lf.valor FROM lf JOIN f USING (indicativo, variable)
    WHERE lf.valor < f.lower OR lf.valor > f.upper""")
def q_iqr_outliers(spark, d):
    """Per station and variable, values outside the Tukey fences."""
    return agg.iqr_outliers(fx.fx_weather(spark, d), ["indicativo"], ["fecha"], _IQR)


@register("iqr_inliers", WITH("fx_weather", extra=_FENCES) + """
    SELECT lf.indicativo, lf.fecha, lf.variable, lf.valor FROM lf JOIN f USING (indicativo, variable)
    WHERE lf.valor > f.lower AND lf.valor < f.upper""")
def q_iqr_inliers(spark, d):
    return agg.iqr_outliers(fx.fx_weather(spark, d), ["indicativo"], ["fecha"], _IQR, inside=True)


_LONG_ALL = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS valor FROM fx_weather" for c in _IQR)


@register("boxplot_summary", WITH("fx_weather", extra={
    "lf": _LONG_ALL,
    "q": "SELECT variable, quantile_cont(valor, 0.25) AS q1, quantile_cont(valor, 0.75) AS q3 FROM lf GROUP BY variable",
    "f": "SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q"}) + f"""
    SELECT lf.variable, {s6('q1')} AS q1, {s6('q3')} AS q3, {s6('lower')} AS lower, {s6('upper')} AS upper,
           {s6('quantile_cont(valor, 0.5)')} AS median,
           min(valor) FILTER (WHERE valor BETWEEN lower AND upper) AS whisker_low,
           max(valor) FILTER (WHERE valor BETWEEN lower AND upper) AS whisker_high,
           count(*) FILTER (WHERE NOT (valor BETWEEN lower AND upper)) AS n_outliers, count(*) AS n
    FROM lf JOIN f USING (variable) GROUP BY lf.variable, q1, q3, lower, upper""")
def q_boxplot_summary(spark, d):
    out = agg.boxplot_summary(fx.fx_weather(spark, d), _IQR)
    return out.withColumns({c: r6(c) for c in ["q1", "q3", "lower", "upper", "median"]})


# ============================================================== statistics

_CORR = ["prec", "tmax", "tmed", "tmin", "velmedia", "racha", "sol", "presmax", "presmin", "rhum"]
_CORR_SQL = {
    "g": "SELECT " + ", ".join(f"corr({a}, {b}) AS {a}__{b}" for a in _CORR for b in _CORR) + " FROM fx_weather",
    "c": " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, {s6(f'{a}__{b}')} AS corr FROM g" for a in _CORR for b in _CORR)}


def _correlations(spark, d):
    return stats.gram_correlation(fx.fx_weather(spark, d), _CORR).withColumn("corr", r6("corr"))


@register("correlation_matrix", WITH("fx_weather", extra=_CORR_SQL) + "SELECT * FROM c")
def q_correlation_matrix(spark, d):
    """All ten weather columns."""
    return _correlations(spark, d)


@register("correlated_pairs", WITH("fx_weather", extra=_CORR_SQL) + "SELECT * FROM c WHERE var_a < var_b AND abs(corr) >= 0.5")
def q_correlated_pairs(spark, d):
    return stats.correlated_pairs(_correlations(spark, d), 0.5)


@register("correlated_drops", WITH("fx_weather", extra=_CORR_SQL | {
    "s": "SELECT var_a AS a, var_b AS b FROM c WHERE var_a <> var_b AND abs(corr) >= 0.3"}) + """
    SELECT * FROM (WITH RECURSIVE t(step, "column", n_partners, gone) AS (
      SELECT CAST(0 AS BIGINT), CAST('' AS VARCHAR), CAST(0 AS BIGINT), CAST([] AS VARCHAR[])
      UNION ALL
      SELECT step + 1, a, n, list_append(gone, a) FROM (
        SELECT t.step, t.gone, s.a, count(*) AS n FROM t JOIN s
          ON NOT list_contains(t.gone, s.a) AND NOT list_contains(t.gone, s.b)
        GROUP BY t.step, t.gone, s.a ORDER BY n DESC, a LIMIT 1))
    SELECT step, "column", n_partners FROM t WHERE step > 0)""")
def q_correlated_drops(spark, d):
    """The columns that a greedy cover of the pairs with |corr| >= 0.3 drops."""
    return stats.correlated_drops(_correlations(spark, d), 0.3)


_LEV = ["prec", "tmax", "tmed", "tmin", "velmedia", "rhum", "sol"]
_LEV_LONG = " UNION ALL ".join(f"SELECT ocurrencia, '{c}' AS variable, CAST({c} AS DOUBLE) AS valor FROM occurrence "
                               f"WHERE {c} IS NOT NULL" for c in _LEV)


@register("levene_w", sj.with_jobs("occurrence", extra={
    "lf": _LEV_LONG,
    "m": "SELECT ocurrencia, variable, avg(valor) AS mu FROM lf GROUP BY ocurrencia, variable",
    "z": "SELECT lf.ocurrencia, lf.variable, abs(lf.valor - m.mu) AS z FROM lf JOIN m USING (ocurrencia, variable)",
    "zg": "SELECT ocurrencia, variable, avg(z) AS zbar_i, count(*) AS n_i FROM z GROUP BY ocurrencia, variable",
    "za": "SELECT variable, avg(z) AS zbar, count(*) AS n FROM z GROUP BY variable",
    "num": "SELECT zg.variable, sum(zg.n_i * (zg.zbar_i - za.zbar) * (zg.zbar_i - za.zbar)) AS b, count(*) AS k "
           "FROM zg JOIN za USING (variable) GROUP BY zg.variable",
    "den": "SELECT z.variable, sum((z.z - zg.zbar_i) * (z.z - zg.zbar_i)) AS wsum FROM z "
           "JOIN zg USING (ocurrencia, variable) GROUP BY z.variable"}) + f"""
    SELECT num.variable, {s6('(za.n - num.k) / (num.k - 1) * num.b / den.wsum')} AS w,
           num.k - 1 AS df1, za.n - num.k AS df2
    FROM num JOIN den USING (variable) JOIN za USING (variable)""")
def q_levene_w(spark, d):
    """Levene's W (mean-centred) of weather variables, fire days vs others."""
    out = stats.levene_w(jobs.occurrence_fx(spark, d), "ocurrencia", _LEV)
    return out.withColumn("w", r6("w"))


@register("levene_test")
def q_levene_test(spark, d):
    """A19 with the p-value of W under F(df1, df2) (no SQL engine here has the
    F distribution, so this one is checked by rows and by unit tests)."""
    return stats.levene_test(jobs.occurrence_fx(spark, d), "ocurrencia", _LEV)


_ACF = ["tmed", "prec", "velmedia", "tmax", "tmin", "rhum", "sol"]
_NLAGS = 60


_ACF_SUMS = {
    "lf": " UNION ALL ".join(f"SELECT indicativo, fecha, '{c}' AS variable, CAST({c} AS DOUBLE) AS valor "
                             f"FROM fx_weather WHERE {c} IS NOT NULL" for c in _ACF),
    "c": "SELECT indicativo, variable, valor - avg(valor) OVER (PARTITION BY indicativo, variable) AS x, "
         "row_number() OVER (PARTITION BY indicativo, variable ORDER BY fecha) AS rn FROM lf",
    "lags": f"SELECT unnest(range(0, {_NLAGS + 1})) AS lag",
    "sums": "SELECT a.indicativo, a.variable, l.lag, sum(a.x * b.x) AS s FROM c a CROSS JOIN lags l "
            "JOIN c b ON b.indicativo = a.indicativo AND b.variable = a.variable AND b.rn = a.rn + l.lag "
            "GROUP BY a.indicativo, a.variable, l.lag"}


@register("acf", WITH("fx_weather", extra=_ACF_SUMS) + f"""
    SELECT s.indicativo, s.variable, CAST(s.lag AS BIGINT) AS lag, {s6('s.s / z.s')} AS acf
    FROM sums s JOIN sums z ON z.indicativo = s.indicativo AND z.variable = s.variable AND z.lag = 0
    WHERE s.lag > 0 AND z.s > 0""")
def q_acf(spark, d):
    """Autocorrelation per station series, lags 1..60."""
    return stats.acf(fx.fx_weather(spark, d), "indicativo", "fecha", _ACF, _NLAGS).withColumn("acf", r6("acf"))


_PACF_STEPS = _ACF_SUMS | {
    "rs": "SELECT s.indicativo, s.variable, list(s.s / z.s ORDER BY s.lag) AS r FROM sums s JOIN sums z ON z.indicativo = s.indicativo "
          "AND z.variable = s.variable AND z.lag = 0 WHERE s.lag > 0 AND z.s > 0 GROUP BY s.indicativo, s.variable",
    "steps": "SELECT indicativo, variable, r, CAST(0 AS BIGINT) AS k, CAST(1 AS DOUBLE) AS v, CAST([] AS DOUBLE[]) AS phi, CAST(NULL AS DOUBLE) AS a FROM rs "
             "UNION ALL SELECT indicativo, variable, r, k + 1, v * (1 - b * b), "
             "list_append(list_transform(range(1, k + 1), lambda j: phi[j] - b * phi[k + 1 - j]), b), b FROM ("
             "SELECT *, (r[k + 1] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j])), 0)) / v AS b "
             "FROM steps WHERE k < len(r))"}


@register("pacf", WITH("fx_weather", extra=_PACF_STEPS).replace("WITH", "WITH RECURSIVE", 1) + f"""
    SELECT indicativo, variable, k AS lag, {s6('a')} AS pacf FROM steps WHERE k > 0""")
def q_pacf(spark, d):
    """Partial autocorrelation (Durbin–Levinson on the ACF rows)."""
    a = stats.acf(fx.fx_weather(spark, d), "indicativo", "fecha", _ACF, _NLAGS)
    return stats.pacf(a, "indicativo").withColumn("pacf", r6("pacf"))


# ============================================================== windows / series

@register("window_sum", WITH("fx_trips") + f"""
    SELECT DISTINCT fecha, destino, {s6('sum(viajes) OVER (PARTITION BY fecha, destino)')} AS total_viajes
    FROM fx_trips""")
def q_window_sum(spark, d):
    """W1, window form: partition totals then one row per partition."""
    w = series.window_sum(fx.fx_trips(spark, d), ["fecha", "destino"], ["viajes"])
    return w.select("fecha", "destino", r6("total_viajes").alias("total_viajes")).distinct()


@register("zone_day_totals", WITH("fx_trips") + f"""
    SELECT fecha, destino, {s6('sum(viajes)')} AS total_viajes, {s6('sum(viajes_km)')} AS total_viajes_km
    FROM fx_trips GROUP BY fecha, destino""")
def q_zone_day_totals(spark, d):
    """W1, intended form: a partial aggregate per (day, zone)."""
    g = series.group_totals(fx.fx_trips(spark, d), ["fecha", "destino"], ["viajes", "viajes_km"])
    return g.withColumns({"total_viajes": r6("total_viajes"), "total_viajes_km": r6("total_viajes_km")})


@register("rank_first", WITH("fx_incidents") + """
    SELECT codi_municipi, incident_id, fecha FROM (
      SELECT *, row_number() OVER (PARTITION BY codi_municipi ORDER BY fecha, incident_id) AS rn FROM fx_incidents)
    WHERE rn = 1""")
def q_rank_first(spark, d):
    """First row per partition by an explicit total order."""
    r = series.rank_first(fx.fx_incidents(spark, d), ["codi_municipi"], [F.col("fecha"), F.col("incident_id")])
    return r.select("codi_municipi", "incident_id", "fecha")


_FF = ", ".join(f"last_value({t} IGNORE NULLS) OVER (PARTITION BY indicativo ORDER BY fecha "
                f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {t}" for t in fx.EVENT_TYPES)
_BF = ", ".join(f"first_value({t} IGNORE NULLS) OVER (PARTITION BY indicativo ORDER BY fecha "
                f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {t}" for t in fx.EVENT_TYPES)


@register("ffill", WITH("fx_daily") + f"SELECT fecha, indicativo, {_FF} FROM fx_daily")
def q_ffill(spark, d):
    return series.forward_fill(fx.fx_daily(spark, d), "indicativo", "fecha", fx.EVENT_TYPES)


@register("bfill", WITH("fx_daily") + f"SELECT fecha, indicativo, {_BF} FROM fx_daily")
def q_bfill(spark, d):
    return series.backward_fill(fx.fx_daily(spark, d), "indicativo", "fecha", fx.EVENT_TYPES)


@register("dedup_keep_first", WITH("fx_readings") + """
    SELECT lectura_id, indicativo, variable, ts, fecha, valor FROM (
      SELECT *, row_number() OVER (PARTITION BY indicativo, variable, valor ORDER BY ts, lectura_id) AS rn
      FROM fx_readings) WHERE rn = 1""")
def q_dedup_keep_first(spark, d):
    """Keep the first reading of each repeated (station, variable,
    value); the order includes the date so repeats on other days are seen."""
    return rel.dedup_by_key(fx.fx_readings(spark, d), ["indicativo", "variable", "valor"],
                            [F.col("ts"), F.col("lectura_id")])


@register("station_series", WITH("fx_weather") + """
    SELECT indicativo, fecha, tmed, row_number() OVER (PARTITION BY indicativo ORDER BY fecha) AS t,
           count(*) OVER (PARTITION BY indicativo) AS n_obs FROM fx_weather""")
def q_station_series(spark, d):
    return series.series_index(fx.fx_weather(spark, d).select("indicativo", "fecha", "tmed"), "indicativo", "fecha")


@register("daily_spine", WITH("fx_weather", extra={
    "b": "SELECT indicativo, min(fecha) AS lo, max(fecha) AS hi FROM fx_weather GROUP BY indicativo",
    "sp": "SELECT indicativo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS fecha FROM b"}) + """
    SELECT sp.indicativo, sp.fecha, w.tmed FROM sp LEFT JOIN fx_weather w
    ON sp.indicativo = w.indicativo AND sp.fecha = w.fecha""")
def q_daily_spine(spark, d):
    """Every calendar day of each station's range, values where present."""
    return series.daily_spine(fx.fx_weather(spark, d).select("indicativo", "fecha", "tmed"), "indicativo")


@register("station_trend", WITH("fx_weather") +
          "SELECT indicativo, fecha, tmin, tmax, tmed, prec, rhum, velmedia, sol FROM fx_weather")
def q_station_trend(spark, d):
    return series.station_trend(fx.fx_weather(spark, d), "indicativo", "fecha",
                                ["tmin", "tmax", "tmed", "prec", "rhum", "velmedia", "sol"])


# ============================================================== sort / distinct / sets

@register("sort_date", WITH("fx_weather") + "SELECT fecha, indicativo, tmed FROM fx_weather ORDER BY fecha, indicativo")
def q_sort_date(spark, d):
    return rel.sort_by(fx.fx_weather(spark, d).select("fecha", "indicativo", "tmed"), "fecha", "indicativo")


@register("topk", WITH("fx_incidents") + """
    SELECT incident_id, codi_municipi, haforestal FROM fx_incidents ORDER BY haforestal DESC, incident_id LIMIT 10""")
def q_topk(spark, d):
    """O2: a top-10 report (the limit is the feature)."""
    return rel.top_n(fx.fx_incidents(spark, d).select("incident_id", "codi_municipi", "haforestal"), 10,
                     [F.col("haforestal").desc(), F.col("incident_id")])


@register("distinct_rows", WITH("fx_readings") + "SELECT DISTINCT indicativo, variable FROM fx_readings")
def q_distinct_rows(spark, d):
    return rel.distinct_rows(fx.fx_readings(spark, d).select("indicativo", "variable"))


@register("dedup_by_key", WITH("fx_incidents") + """
    SELECT incident_id, codi_municipi, fecha, haforestal, estado FROM (
      SELECT *, row_number() OVER (PARTITION BY codi_municipi, fecha ORDER BY haforestal DESC, incident_id) AS rn
      FROM fx_incidents) WHERE rn = 1""")
def q_dedup_by_key(spark, d):
    """One incident per (municipality, day): the largest, ties by id."""
    return rel.dedup_by_key(fx.fx_incidents(spark, d), ["codi_municipi", "fecha"],
                            [-F.col("haforestal"), F.col("incident_id")])


@register("duplicated_rows", WITH("fx_readings") + """
    SELECT indicativo, variable, fecha, count(*) AS n_copies FROM fx_readings
    GROUP BY indicativo, variable, fecha HAVING count(*) > 1""")
def q_duplicated_rows(spark, d):
    return rel.duplicated_rows(fx.fx_readings(spark, d).select("indicativo", "variable", "fecha"))


@register("dropna", WITH("fx_daily") + "SELECT * FROM fx_daily WHERE " +
          " AND ".join(f"{c} IS NOT NULL" for c in ["fecha", "indicativo"] + fx.EVENT_TYPES))
def q_dropna(spark, d):
    return rel.drop_any_null(fx.fx_daily(spark, d))


@register("union_sources", WITH("fx_readings", "fx_variables", "fx_weather", extra={
    "piv": "SELECT fecha, indicativo, " + ", ".join(
        f"sum(valor) FILTER (WHERE nom_variable = '{n}') AS {n}" for n in fx.VARIABLE_NAMES) +
           " FROM fx_readings r JOIN fx_variables v ON r.variable = v.codi_variable GROUP BY fecha, indicativo"}) + f"""
    SELECT fecha, indicativo, {s6('prec')} AS prec, {s6('racha')} AS racha,
           {s6('coalesce(velmedia_10m, velmedia_2m, velmedia_6m)')} AS velmedia,
           CAST(NULL AS DOUBLE) AS tmed, 'meteocat' AS fuente FROM piv
    UNION ALL SELECT fecha, indicativo, prec, racha, velmedia, tmed, 'aemet' FROM fx_weather""")
def q_union_sources(spark, d):
    """Two sources aligned by name to one schema, tagged, unioned."""
    first = jobs.climate_pivot(fx.fx_readings(spark, d), fx.fx_variables(spark, d))
    first = first.withColumns({c: r6(c) for c in ["prec", "racha", "velmedia"]})
    second = fx.fx_weather(spark, d)
    return rel.union_sources({"meteocat": first, "aemet": second}, jobs.CLIMATE_SCHEMA)


# ============================================================== scalar functions

@register("split_get", """
    SELECT event_id, string_split(props, ' ')[2] AS parte, string_split(props, ' ')[6] AS fuera FROM events""")
def q_split_get(spark, d):
    """Split + index; an index past the end gives null, not an error."""
    e = fx.table(spark, d, "events")
    return e.select("event_id", tx.split_get("props", " ", 1).alias("parte"),
                    tx.split_get("props", " ", 5).alias("fuera"))


@register("path_date_parts", WITH("fx_trips") + r"""
    SELECT fecha, fichero, CAST(regexp_extract(fichero, '^(\d{4})(\d{2})', 1) AS INTEGER) AS year,
           CAST(regexp_extract(fichero, '^(\d{4})(\d{2})', 2) AS INTEGER) AS month FROM (
      SELECT DISTINCT fecha, string_split('/landing/viajes/' || strftime(fecha, '%Y%m%d') || '_Viajes_municipios.csv', '/')[-1]
        AS fichero FROM fx_trips)""")
def q_path_date_parts(spark, d):
    """Last path component, then year and month from a regex."""
    t = fx.fx_trips(spark, d).select("fecha").distinct()
    path = F.concat(F.lit("/landing/viajes/"), F.date_format("fecha", "yyyyMMdd"), F.lit("_Viajes_municipios.csv"))
    t = t.withColumn("fichero", tx.last_path_part(path))
    return t.withColumns({"year": tx.regex_group("fichero", r"^(\d{4})(\d{2})", 1).cast("int"),
                          "month": tx.regex_group("fichero", r"^(\d{4})(\d{2})", 2).cast("int")})


@register("code_prefix", WITH("fx_municipalities") + """
    SELECT codigo_municipio, substring(codigo_municipio, 1, 5) AS cod_municipio,
           substring(codigo_municipio, 1, length(codigo_municipio) - 1) AS sin_control FROM fx_municipalities""")
def q_code_prefix(spark, d):
    m = fx.fx_municipalities(spark, d)
    return m.select("codigo_municipio", tx.code_prefix("codigo_municipio", 5).alias("cod_municipio"),
                    tx.drop_last_char("codigo_municipio").alias("sin_control"))


@register("code_concat", WITH("fx_municipalities") + """
    SELECT codigo_municipio, lpad(CAST(comarca AS VARCHAR), 2, '0') || codigo_municipio AS codigo_completo
    FROM fx_municipalities""")
def q_code_concat(spark, d):
    m = fx.fx_municipalities(spark, d)
    return m.select("codigo_municipio",
                    tx.concat_codes(F.lpad(F.col("comarca").cast("string"), 2, "0"), "codigo_municipio")
                    .alias("codigo_completo"))


@register("sensor_coalesce", WITH("fx_readings", "fx_variables", extra={
    "piv": "SELECT fecha, indicativo, " + ", ".join(
        f"sum(valor) FILTER (WHERE nom_variable = '{n}') AS {n}" for n in fx.VARIABLE_NAMES) +
           " FROM fx_readings r JOIN fx_variables v ON r.variable = v.codi_variable GROUP BY fecha, indicativo"}) + f"""
    SELECT fecha, indicativo, {s6('coalesce(velmedia_10m, velmedia_2m, velmedia_6m)')} AS velmedia,
           {s6('''CASE WHEN (CASE WHEN velmedia_10m IS NULL THEN 0 ELSE 1 END + CASE WHEN velmedia_2m IS NULL THEN 0 ELSE 1 END
                  + CASE WHEN velmedia_6m IS NULL THEN 0 ELSE 1 END) <= 1
                  THEN coalesce(velmedia_10m, velmedia_2m, velmedia_6m) END''')} AS velmedia_estricta
    FROM piv""")
def q_sensor_coalesce(spark, d):
    """First sensor present in the stated order; strict variant."""
    p = jobs.climate_pivot(fx.fx_readings(spark, d), fx.fx_variables(spark, d))
    return p.select("fecha", "indicativo",
                    r6(tx.first_available("velmedia_10m", "velmedia_2m", "velmedia_6m")).alias("velmedia"),
                    r6(tx.first_available("velmedia_10m", "velmedia_2m", "velmedia_6m", strict=True))
                    .alias("velmedia_estricta"))


@register("decimal_comma", WITH("fx_dirty") + f"SELECT id, {sj.num('valor_txt')} AS valor FROM fx_dirty")
def q_decimal_comma(spark, d):
    """Decimal comma repaired; ':', '-', 'nan', '' -> null."""
    return fx.fx_dirty(spark, d).select("id", tx.to_number("valor_txt").alias("valor"))


@register("parse_date", WITH("fx_dirty") + """
    SELECT id, coalesce(CAST(try_strptime(fecha_txt, '%Y-%m-%d') AS DATE), CAST(try_strptime(fecha_txt, '%Y%m%d') AS DATE),
                        CAST(try_strptime(fecha_txt, '%d/%m/%Y') AS DATE)) AS fecha FROM fx_dirty""")
def q_parse_date(spark, d):
    """Several formats tried; text that fits none -> null."""
    return fx.fx_dirty(spark, d).select("id", tx.parse_date("fecha_txt").alias("fecha"))


@register("calendar_features", WITH("fx_weather") + """
    SELECT fecha, CAST(isodow(fecha) - 1 AS BIGINT) AS laborable, CAST(dayofyear(fecha) AS BIGINT) AS dayofyear,
           CAST(CASE WHEN isodow(fecha) - 1 > 4 THEN 1 ELSE 0 END AS BIGINT) AS weekend,
           CAST(month(fecha) AS BIGINT) AS mes
    FROM (SELECT DISTINCT fecha FROM fx_weather)""")
def q_calendar_features(spark, d):
    return tx.add_calendar(fx.fx_weather(spark, d).select("fecha").distinct())


@register("placeholder_replace", WITH("fx_dirty") + """
    SELECT id, CASE WHEN vulner_txt = '-' THEN 'Moderada' ELSE vulner_txt END AS vulner,
           CASE WHEN valor_txt = ':' THEN NULL ELSE valor_txt END AS valor_txt FROM fx_dirty""")
def q_placeholder_replace(spark, d):
    return fx.fx_dirty(spark, d).select("id", tx.replace_placeholder("vulner_txt", "-", "Moderada").alias("vulner"),
                                        tx.replace_placeholder("valor_txt", ":", None).alias("valor_txt"))


@register("round_all", WITH("fx_weather") + "SELECT fecha, indicativo, " +
          ", ".join(f"{sj.rnd(c)} AS {c}" for c in W) + " FROM fx_weather")
def q_round_all(spark, d):
    return tx.round_all(fx.fx_weather(spark, d), 2)


@register("impute_mean", WITH("fx_daily") + "SELECT fecha, indicativo, " + ", ".join(
    f"{s6(f'coalesce({t}, (SELECT avg({t}) FROM fx_daily))')} AS {t}" for t in ["click", "view"]) + " FROM fx_daily")
def q_impute_mean(spark, d):
    """Nulls replaced by the column mean."""
    out = tx.impute_mean(fx.fx_daily(spark, d).select("fecha", "indicativo", "click", "view"), ["click", "view"])
    return out.withColumns({"click": r6("click"), "view": r6("view")})


@register("fill_zero", WITH("fx_daily") + "SELECT fecha, indicativo, " +
          ", ".join(f"coalesce({t}, 0.0) AS {t}" for t in fx.EVENT_TYPES) + " FROM fx_daily")
def q_fill_zero(spark, d):
    return tx.fill_zero(fx.fx_daily(spark, d), fx.EVENT_TYPES)


_DMS_SQL = ("(CAST(substring({c}, 1, 2) AS DOUBLE) + CAST(substring({c}, 3, 2) AS DOUBLE) / 60.0 + "
            "CAST(substring({c}, 5, 2) AS DOUBLE) / 3600.0) * CASE WHEN upper(right({c}, 1)) IN ('W', 'S') "
            "THEN -1.0 ELSE 1.0 END")


@register("dms_to_decimal", WITH("fx_stations") + f"""
    SELECT indicativo, lat_dms, lon_dms, {s6(_DMS_SQL.format(c='lat_dms'))} AS lat,
           {s6(_DMS_SQL.format(c='lon_dms'))} AS lon FROM fx_stations""")
def q_dms_to_decimal(spark, d):
    """DDMMSSH text -> signed decimal degrees (native, no Python UDF)."""
    s = fx.fx_stations(spark, d)
    return s.select("indicativo", "lat_dms", "lon_dms", r6(geo.dms_to_decimal("lat_dms")).alias("lat"),
                    r6(geo.dms_to_decimal("lon_dms")).alias("lon"))


@register("distance_m", WITH("fx_stations") + f"""
    SELECT a.indicativo, b.indicativo AS vecino,
           {sj.rnd(geo.haversine_sql('a.latitud', 'a.longitud', 'b.latitud', 'b.longitud'), 3)} AS distancia_m
    FROM fx_stations a JOIN fx_stations b ON b.indicativo = a.indicativo + 1""")
def q_distance_m(spark, d):
    """C14: haversine metres between consecutive stations."""
    s = fx.fx_stations(spark, d)
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, F.col("b.indicativo") == F.col("a.indicativo") + 1)
    return j.select(F.col("a.indicativo").alias("indicativo"), F.col("b.indicativo").alias("vecino"),
                    tx.round_half_up(geo.haversine_m("a.latitud", "a.longitud", "b.latitud", "b.longitud"), 3)
                    .alias("distancia_m"))


@register("clean_name", WITH("fx_municipalities") + """
    SELECT codigo_municipio, string_split(municipio, '#')[1] || ', Catalunya' AS nombre FROM fx_municipalities""")
def q_clean_name(spark, d):
    return fx.fx_municipalities(spark, d).select(
        "codigo_municipio", tx.clean_name("municipio", ", Catalunya", sep="#").alias("nombre"))


@register("override_lookup", sj.with_jobs("bridge") + "SELECT codigo_municipio, latitud, longitud FROM bridge_pts")
def q_override_lookup(spark, d):
    """Keyed overrides of coordinates (left join + coalesce)."""
    m = fx.fx_municipalities(spark, d)
    pts = m.select("codigo_municipio", "latitud", "longitud")
    return jobs.apply_overrides(pts, jobs.station_overrides(m), "codigo_municipio", ["latitud", "longitud"])


@register("array_features", WITH("fx_weather") +
          "SELECT indicativo, fecha, [prec, tmax, tmed, velmedia] AS feats FROM fx_weather")
def q_array_features(spark, d):
    """Fixed-order feature array per row."""
    return fx.fx_weather(spark, d).select("indicativo", "fecha",
                                          tx.array_features("prec", "tmax", "tmed", "velmedia").alias("feats"))
