"""Registered learning-data, model and evaluation queries (M*, D*, E9)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.text import round_half_up
from ..operators import evaluate as ev
from ..operators import features as feat
from ..operators import histtrees as ht
from ..operators import models as md
from ..operators import sampling as smp
from ..sources.files import materialize, scratch_path, write_csv_partitioned
from . import jobs
from . import sql_jobs as sj
from .catalog import register

r6 = lambda c: round_half_up(c, 6)
s6 = lambda e: sj.rnd(e, 6)
KEYS = ["indicativo", "fecha"]
SEED = 123
N_NEGATIVE = 3029  # fixed value: negatives kept by the reference's down-sampling
CUTOFF = "2000-01-01"
WINDOW = ("1998-02-21", "1999-05-09")
NUMERIC = ["prec", "tmed", "velmedia", "racha", "sol", "presmax", "rhum", "altitud", "porcentaje_pendiente_total",
           "total_viajes_estacion"]
CATS = ["alto_riesgo", "peligro", "vulner"]
CALENDAR = ["laborable", "dayofyear", "weekend", "mes"]
LABEL = "ocurrencia"

_MD5 = "md5(concat_ws('|', CAST(indicativo AS VARCHAR), CAST(fecha AS VARCHAR), '{seed}'))"


def _base(spark, d):
    return jobs.clean_fx(spark, d)


_CLEAN_TABLES: dict[tuple[str, str], str] = {}


def _clean_table(spark, d):
    """The cleaned table (E8) written once per application and data folder
    under the shared checkpoint folder, then read by the sampling, split and model
    queries.  A data folder that changes needs a new application."""
    key = (spark.sparkContext.applicationId, d)
    path = _CLEAN_TABLES.get(key)
    if path is not None:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:  # the folder was cleared: write it again
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    path = scratch_path(spark, "clean")
    _base(spark, d).write.mode("overwrite").parquet(path)
    _CLEAN_TABLES[key] = path
    return spark.read.parquet(path)


# ============================================================== sampling / splits

@register("downsample_fixed", sj.with_jobs("clean") + f"""
    SELECT fecha, indicativo, ocurrencia FROM clean WHERE ocurrencia <> 0
    UNION ALL
    SELECT fecha, indicativo, ocurrencia FROM (
      SELECT *, row_number() OVER (ORDER BY {_MD5.format(seed=SEED)}) AS rn FROM clean WHERE ocurrencia = 0)
    WHERE rn <= {N_NEGATIVE}""")
def q_downsample_fixed(spark, d):
    """M1: all positives + 3029 hash-chosen negatives (exact, repeatable)."""
    b = _clean_table(spark, d).select("fecha", "indicativo", LABEL)
    return smp.downsample(b, LABEL, N_NEGATIVE, KEYS, SEED)


@register("undersample_parity", sj.with_jobs("clean", extra={
    "pos": "SELECT count(*) AS n FROM clean WHERE ocurrencia = 1"}) + f"""
    SELECT fecha, indicativo, ocurrencia FROM clean WHERE ocurrencia = 1
    UNION ALL
    SELECT fecha, indicativo, ocurrencia FROM (
      SELECT *, row_number() OVER (ORDER BY {_MD5.format(seed=SEED)}) AS rn FROM clean WHERE ocurrencia = 0)
    WHERE rn <= (SELECT n FROM pos)""")
def q_undersample_parity(spark, d):
    """M2: majority cut to the minority's size."""
    b = _clean_table(spark, d).select("fecha", "indicativo", LABEL)
    return smp.undersample_parity(b, LABEL, KEYS, SEED)


@register("split_random", sj.with_jobs("clean") + f"""
    SELECT fecha, indicativo, CASE WHEN rn <= ceil(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM (
      SELECT fecha, indicativo, row_number() OVER (ORDER BY {_MD5.format(seed=SEED)}) AS rn,
             count(*) OVER () AS n FROM clean)""")
def q_split_random(spark, d):
    """M4: exact 80/20 split by hash order."""
    return smp.split_random(_clean_table(spark, d).select("fecha", "indicativo"), KEYS, 0.8, SEED)


@register("split_ordered", sj.with_jobs("clean") + """
    SELECT fecha, indicativo, CASE WHEN rn <= ceil(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM (
      SELECT fecha, indicativo, row_number() OVER (ORDER BY fecha, indicativo) AS rn, count(*) OVER () AS n
      FROM clean)""")
def q_split_ordered(spark, d):
    """M5/Q15: first 80 % in (date, station) order -> train."""
    order = F.unix_date("fecha").cast("long") * F.lit(1 << 32) + F.col("indicativo")
    return smp.split_ordered(_clean_table(spark, d).select("fecha", "indicativo"), order, 0.8)


@register("split_time", sj.with_jobs("clean") + f"""
    SELECT fecha, indicativo, CASE WHEN fecha < DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS split FROM clean""")
def q_split_time(spark, d):
    """M6: calendar split."""
    return feat.split_time(_clean_table(spark, d).select("fecha", "indicativo"), "fecha", CUTOFF)


_STD = ["prec", "tmed", "velmedia", "rhum", "altitud", "porcentaje_pendiente_total", "total_viajes_estacion"]


@register("standardize", sj.with_jobs("clean", extra={
    "sp": f"SELECT *, CASE WHEN fecha < DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS split FROM clean",
    "st": "SELECT " + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in _STD) +
          " FROM sp WHERE split = 'train'"}) + "SELECT fecha, indicativo, split, " + ", ".join(
    f"{s6(f'CASE WHEN sd_{c} > 0 THEN ({c} - mu_{c}) / sd_{c} ELSE 0.0 END')} AS {c}" for c in _STD) +
    " FROM sp CROSS JOIN st")
def q_standardize(spark, d):
    """M7: standardised with train mean and population deviation."""
    b = feat.split_time(_clean_table(spark, d), "fecha", CUTOFF).select("fecha", "indicativo", "split", *_STD)
    out = feat.standardize(b, _STD)
    return out.withColumns({c: r6(c) for c in _STD})


def _ohe_ix(c: str) -> str:
    k = f"(SELECT count(DISTINCT {c}) FROM sp WHERE split = 'train' AND {c} IS NOT NULL)"
    idx = (f"CASE WHEN {c} IN (SELECT {c} FROM sp WHERE split = 'train') THEN "
           f"(SELECT count(DISTINCT t.{c}) FROM sp t WHERE t.split = 'train' AND t.{c} < o.{c}) ELSE {k} END")
    return f"CAST({idx} AS BIGINT) AS {c}_idx, {k} AS {c}_k"


def _ohe_arr(c: str) -> str:
    return (f"{c}_idx, CAST(list_transform(range({c}_k + 1), lambda i: CASE WHEN i = {c}_idx THEN 1.0 ELSE 0.0 END) "
            f"AS DOUBLE[]) AS {c}_ohe")


@register("one_hot", sj.with_jobs("clean", extra={
    "sp": f"SELECT *, CASE WHEN fecha < DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS split FROM clean",
    "ix": "SELECT o.fecha, o.indicativo, " + ", ".join(_ohe_ix(c) for c in CATS) + " FROM sp o"}) +
    "SELECT fecha, indicativo, " + ", ".join(_ohe_arr(c) for c in CATS) + " FROM ix")
def q_one_hot(spark, d):
    """M8/Q14: indexes fitted once on train (alphabetical, unseen -> last)."""
    b = feat.split_time(_clean_table(spark, d), "fecha", CUTOFF)
    out = feat.one_hot(b, CATS)
    return out.select("fecha", "indicativo", *[x for c in CATS for x in (f"{c}_idx", f"{c}_ohe")])


@register("class_weights", sj.with_jobs("clean") + """
    SELECT ocurrencia, count(*) AS n_c,
           sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
    FROM clean GROUP BY ocurrencia""")
def q_class_weights(spark, d):
    """Balanced class weights n / (k * n_c)."""
    return smp.class_weights(_clean_table(spark, d), LABEL)


_MOB = ["total_viajes_estacion", "total_viajes_km_estacion"]
_NALL = 2 + len(sj._MAX_COLS)


@register("analysis_subsets", sj.with_jobs("clean") + f"""
    SELECT 'all' AS subset, count(*) AS n_rows, CAST({_NALL} AS BIGINT) AS n_cols FROM clean UNION ALL
    SELECT 'sin_movilidad', count(*), CAST({_NALL - 2} AS BIGINT) FROM clean UNION ALL
    SELECT 'ventana', count(*), CAST({_NALL} AS BIGINT) FROM clean
      WHERE fecha BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}' UNION ALL
    SELECT 'ventana_sin_movilidad', count(*), CAST({_NALL - 2} AS BIGINT) FROM clean
      WHERE fecha BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'""")
def q_analysis_subsets(spark, d):
    """The four analysis views (row and column counts)."""
    subs = feat.analysis_subsets(_clean_table(spark, d), "fecha", WINDOW, _MOB)
    out = None
    for name, df in subs.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("subset"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))
        out = part if out is None else out.unionByName(part)
    return out


def _subset_sql(name: str, window: bool, mobility: bool) -> str:
    cols = [c for c in sj._MAX_COLS if mobility or c not in _MOB]
    where = " AND ".join([f"{c} IS NOT NULL" for c in cols] + ([f"fecha BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'"] if window else []))
    trips = _MOB[0] if mobility else "CAST(NULL AS DOUBLE)"
    return (f"SELECT '{name}' AS subset, indicativo, count(*) AS n_rows, CAST(sum(ocurrencia) AS BIGINT) AS n_occurrences, "
            f"min(fecha) AS first_day, max(fecha) AS last_day, {s6(f'sum({trips})')} AS trips "
            f"FROM (SELECT DISTINCT fecha, indicativo, {', '.join(cols)} FROM clean WHERE {where}) GROUP BY indicativo")


@register("subset_files", sj.with_jobs("clean") + " UNION ALL ".join([
    _subset_sql("all", False, True), _subset_sql("sin_movilidad", False, False),
    _subset_sql("ventana", True, True), _subset_sql("ventana_sin_movilidad", True, False)]))
def q_subset_files(spark, d):
    """The four subsets without nulls and repeated rows, written as ``;`` text in one go, read
    back, and told by station."""
    rows = feat.subset_rows(_clean_table(spark, d), "fecha", WINDOW, _MOB)
    path = write_csv_partitioned(rows, scratch_path(spark, "subsets"), ["subset"])
    back = spark.read.schema(rows.schema).option("header", True).option("sep", ";").csv(path)
    return back.groupBy("subset", "indicativo").agg(
        F.count("*").alias("n_rows"), F.sum(LABEL).cast("long").alias("n_occurrences"), F.min("fecha").alias("first_day"),
        F.max("fecha").alias("last_day"), r6(F.sum(_MOB[0])).alias("trips"))


# ============================================================== evaluation (deterministic scores)

_SWEEP = " UNION ALL ".join(f"SELECT {t} AS threshold" for t in ev.THRESHOLDS)


@register("threshold_sweep", fx.sql_with("fx_scored", extra={"t": _SWEEP}) + f"""
    SELECT threshold, tp, fp, tn, fn, {s6('(tp + tn) / (tp + fp + tn + fn)')} AS accuracy,
           {s6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END')} AS precision,
           {s6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END')} AS recall FROM (
      SELECT CAST(t.threshold AS DOUBLE) AS threshold,
             count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp,
             count(*) FILTER (WHERE score >= threshold AND label <> 1) AS fp,
             count(*) FILTER (WHERE score < threshold AND label <> 1) AS tn,
             count(*) FILTER (WHERE score < threshold AND label = 1) AS fn
      FROM fx_scored CROSS JOIN t GROUP BY t.threshold)""")
def q_threshold_sweep(spark, d):
    """Metrics at each probability threshold."""
    out = ev.threshold_sweep(fx.fx_scored(spark, d), "label", "score")
    return out.withColumns({c: r6(c) for c in ["accuracy", "precision", "recall"]})


_PRED = "SELECT id, label, CAST(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS pred FROM fx_scored"
_REPORT = {
    "p": _PRED,
    "cls": "SELECT label AS clase FROM p UNION SELECT pred FROM p",
    "rep": """SELECT c.clase,
                 coalesce((SELECT count(*) FROM p WHERE label = c.clase AND pred = c.clase) /
                          nullif((SELECT count(*) FROM p WHERE pred = c.clase), 0), 0.0) AS precision,
                 coalesce((SELECT count(*) FROM p WHERE label = c.clase AND pred = c.clase) /
                          nullif((SELECT count(*) FROM p WHERE label = c.clase), 0), 0.0) AS recall,
                 (SELECT count(*) FROM p WHERE label = c.clase) AS support FROM cls c""",
    "rep2": "SELECT clase, precision, recall, CASE WHEN precision + recall > 0 THEN "
            "2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, support FROM rep"}


@register("classification_report", fx.sql_with("fx_scored", extra=_REPORT) + f"""
    SELECT clase, {s6('precision')} AS precision, {s6('recall')} AS recall, {s6('f1')} AS f1, support FROM rep2""")
def q_classification_report(spark, d):
    """Per-class precision, recall, F1, support at threshold 0.5."""
    p = ev.predict_at(fx.fx_scored(spark, d), "score", 0.5)
    out = ev.classification_report(p, "label", "pred")
    return out.withColumns({c: r6(c) for c in ["precision", "recall", "f1"]})


@register("macro_metrics", fx.sql_with("fx_scored", extra=_REPORT) + f"""
    SELECT {s6('(SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) FROM p)')} AS accuracy,
           {s6('avg(precision)')} AS precision_macro, {s6('avg(recall)')} AS recall_macro,
           {s6('avg(f1)')} AS f1_macro FROM rep2""")
def q_macro_metrics(spark, d):
    """Accuracy and macro-averaged precision / recall / F1."""
    p = ev.predict_at(fx.fx_scored(spark, d), "score", 0.5)
    out = ev.macro_metrics(p, "label", "pred")
    return out.select(*[r6(c).alias(c) for c in out.columns])


@register("confusion_matrix", fx.sql_with("fx_scored", extra={"p": _PRED}) + f"""
    SELECT label, pred, count(*) AS n, {s6('count(*) / sum(count(*)) OVER ()')} AS share
    FROM p GROUP BY label, pred""")
def q_confusion_matrix(spark, d):
    """Counts and shares per (label, prediction)."""
    p = ev.predict_at(fx.fx_scored(spark, d), "score", 0.5)
    return ev.confusion_matrix(p, "label", "pred").withColumn("share", r6("share"))


@register("log_loss", fx.sql_with("fx_scored") + f"""
    SELECT {s6('-avg(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + '
               '(1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))')} AS log_loss,
           count(*) AS n FROM fx_scored""")
def q_log_loss(spark, d):
    """Binary cross-entropy of the scores."""
    return ev.log_loss(fx.fx_scored(spark, d), "label", "score").withColumn("log_loss", r6("log_loss"))


# ============================================================== models (rows-only checks)

def _prepared(spark, d):
    """Split by time, standardise on train, assemble scaled + one-hot + calendar.

    The cleaned table and the assembled frame are written once to the shared
    checkpoint folder: model fitting passes over its input many times and must
    not replay the whole job lineage on each pass."""
    b = feat.split_time(_clean_table(spark, d), "fecha", CUTOFF)
    b = feat.standardize(b, NUMERIC, suffix="_z")
    b = smp.with_class_weights(b, LABEL)
    pipe = feat.assemble_pipeline([f"{c}_z" for c in NUMERIC], CATS, CALENDAR).fit(b.where("split = 'train'"))
    out = materialize(pipe.transform(b).withColumn(LABEL, F.col(LABEL).cast("double")), "assembled")
    return out.where("split = 'train'"), out.where("split = 'test'")


def _scored(pred):
    return md.positive_probability(pred).select("fecha", "indicativo", LABEL, "prediction", "p1")


@register("assemble")
def q_assemble(spark, d):
    """M9: the assembled feature vector (as an array) per row."""
    tr, te = _prepared(spark, d)
    return tr.unionByName(te).select("fecha", "indicativo", "split", vector_to_array("features").alias("features"))


@register("decision_tree")
def q_decision_tree(spark, d):
    """Entropy tree with class weights; test-set predictions."""
    tr, te = _prepared(spark, d)
    return _scored(md.decision_tree(weight="weight", max_depth=10, min_leaf=5).fit(tr).transform(te))


@register("random_forest")
def q_random_forest(spark, d):
    """1000 trees of depth 30, as the reference's."""
    tr, te = _prepared(spark, d)
    return _scored(md.random_forest(n_trees=1000, max_depth=30, min_leaf=10).fit(tr).transform(te))


@register("gbt")
def q_gbt(spark, d):
    """Boosted trees, logistic loss."""
    tr, te = _prepared(spark, d)
    return _scored(md.gbt(max_iter=20, max_depth=5, step=0.1).fit(tr).transform(te))


@register("mlp")
def q_mlp(spark, d):
    """Perceptron over the assembled features, trained on a balanced sample."""
    tr, te = _prepared(spark, d)
    n = len(tr.schema["features"].metadata["ml_attr"]["attrs"]["numeric"]) + \
        len(tr.schema["features"].metadata["ml_attr"]["attrs"].get("binary", []))
    bal = smp.undersample_parity(tr, LABEL, KEYS, SEED)
    return _scored(md.mlp(n, max_iter=50).fit(bal).transform(te))


@register("grid_search")
def q_grid_search(spark, d):
    """3-fold grid search over depth and minimum leaf size; predictions of
    the chosen model (quirk Q17)."""
    tr, te = _prepared(spark, d)
    cv = md.grid_search(md.decision_tree(weight="weight"), {"maxDepth": [5, 10], "minInstancesPerNode": [5, 10]},
                        folds=3)
    return _scored(cv.fit(tr).bestModel.transform(te))


@register("fold_sizes", sj.with_jobs("clean") + f"""
    SELECT CAST(CAST('0x' || substr({_MD5.format(seed=SEED)}, 1, 15) AS BIGINT) % 3 AS INTEGER) AS fold, ocurrencia, count(*) AS n_rows
    FROM clean GROUP BY ALL""")
def q_fold_sizes(spark, d):
    """Rows of each fold and class."""
    return md.with_folds(_clean_table(spark, d), KEYS, 3, SEED).groupBy("fold", LABEL).agg(F.count("*").alias("n_rows"))


@register("grid_search_weights")
def q_grid_search_weights(spark, d):
    """D6 with D9: 3 x 3 grid over the class weight and the depth, folds from a written column."""
    tr = materialize(md.with_folds(_prepared(spark, d)[0].drop("weight"), KEYS, 3, SEED), "folds")
    stages = Pipeline(stages=[md.ClassWeighter(LABEL), md.decision_tree(weight="weight")])
    cv = md.grid_search(stages, {"positiveWeight": [1.0, 5.0, 10.0], "maxDepth": [3, 5, 10]}, fold_col="fold", metric="f1")
    return md.grid_scores(spark, cv.fit(tr))


@register("feature_importance")
def q_feature_importance(spark, d):
    """Named importances of a boosted model."""
    tr, te = _prepared(spark, d)
    m = md.gbt(max_iter=10, max_depth=4).fit(tr)
    return md.feature_importance(spark, m, tr)


@register("balanced_forest")
def q_balanced_forest(spark, d):
    """D3: trees on balanced hash samples, probabilities averaged."""
    tr, te = _prepared(spark, d)
    models = md.balanced_forest(tr, KEYS, n_trees=5)
    out = md.average_probability(models, te)
    return out.select("fecha", "indicativo", LABEL, (F.col("p1") >= 0.5).cast("double").alias("prediction"), "p1")


@register("adaboost")
def q_adaboost(spark, d):
    """SAMME over stumps (5 rounds here; the count is a parameter)."""
    tr, te = _prepared(spark, d)
    rounds = md.adaboost(tr, n_rounds=5, rate=0.1)
    return md.adaboost_score(rounds, te).select("fecha", "indicativo", LABEL, "prediction", "score")


# ============================================================== boosting on binned features

_BINS, _L2, _MIN_H = 16, 1.0, 1.0
_TREE_COLS = [*NUMERIC, *CALENDAR]


def _binned(spark, d):
    """Training rows, test rows: features rounded to six places and cut into bins of equal width (the
    cuts are those of the training rows)."""
    b = feat.split_time(_clean_table(spark, d), "fecha", CUTOFF)
    b = b.withColumns({c: F.round(F.col(c).cast("double"), 6) if c in CALENDAR else r6(c) for c in _TREE_COLS})
    train = b.where("split = 'train'")
    out = materialize(ht.binned(b, _TREE_COLS, ht.width_cuts(train, _TREE_COLS, _BINS)).select("fecha", "indicativo", LABEL, "split", "bins"), "binned")
    return out.where("split = 'train'"), out.where("split = 'test'")


_X = {c: (f"CAST({c} AS DOUBLE)" if c in CALENDAR else s6(c)) for c in _TREE_COLS}
_BIN_SQL = {
    "tr": f"SELECT row_number() OVER () AS id, CAST(ocurrencia AS DOUBLE) AS y, {', '.join(f'{x} AS {c}' for c, x in _X.items())} FROM clean WHERE fecha < DATE '{CUTOFF}' AND ocurrencia IS NOT NULL",
    "edge": "SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _TREE_COLS) + " FROM tr",
    "cell": " UNION ALL ".join(
        f"SELECT id, y, {i} AS f, CASE WHEN {c} IS NULL OR hi_{c} = lo_{c} THEN 0 ELSE len(list_filter(list_transform(range(1, {_BINS}), lambda b: lo_{c} + (hi_{c} - lo_{c}) * b / {_BINS}.0::DOUBLE), lambda e: e < {c})) END AS bin FROM tr CROSS JOIN edge"
        for i, c in enumerate(_TREE_COLS)),
}
_NAME_SQL = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_TREE_COLS)) + " END"


def _level_sql(rows: str) -> dict[str, str]:
    """Best split of every node of a level; rows: id, node, g, h."""
    return {
        "hist": f"SELECT r.node, c.f, c.bin, sum(r.g) AS g, sum(r.h) AS h FROM {rows} r JOIN cell c USING (id) GROUP BY ALL",
        "cum": "SELECT node, f, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER p AS gt, sum(h) OVER p AS ht, max(bin) OVER p AS last FROM hist "
               "WINDOW w AS (PARTITION BY node, f ORDER BY bin), p AS (PARTITION BY node, f)",
        "gains": f"SELECT node, f, bin, 0.5 * (gl * gl / (hl + {_L2}) + (gt - gl) * (gt - gl) / (ht - hl + {_L2}) - gt * gt / (ht + {_L2})) AS gain FROM cum WHERE bin < last AND hl >= {_MIN_H} AND ht - hl >= {_MIN_H}",
        "best": "SELECT node, f, bin, gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 7) DESC, f, bin) AS rn FROM gains WHERE gain > 0) WHERE rn = 1",
        "sums": f"SELECT node, sum(g) AS g, sum(h) AS h FROM {rows} GROUP BY node",
    }


def _first_tree_sql(depth: int) -> str:
    """The nodes of a first boosted tree, level by level."""
    parts = dict(_BIN_SQL)
    parts["prior"] = "SELECT avg(y) AS p FROM tr"
    parts["r0"] = "SELECT id, 1 AS node, p - y AS g, p * (1 - p) AS h FROM tr CROSS JOIN prior"
    ends = []
    for k in range(depth + 1):
        for name, sql in _level_sql(f"r{k}").items():
            for other in ("hist", "cum", "gains"):
                sql = sql.replace(f"FROM {other}", f"FROM {other}{k}")
            parts[f"{name}{k}"] = sql
        if k < depth:
            parts[f"r{k + 1}"] = (f"SELECT r.id, 2 * r.node + CASE WHEN c.bin <= b.bin THEN 0 ELSE 1 END AS node, r.g, r.h "
                                  f"FROM r{k} r JOIN best{k} b USING (node) JOIN cell c ON c.id = r.id AND c.f = b.f")
        leaf = f"SELECT s.node, CAST(NULL AS VARCHAR) AS feature, CAST(NULL AS INT) AS bin, 0.0 AS gain, -s.g / (s.h + {_L2}) AS weight FROM sums{k} s"
        ends.append(leaf if k == depth else leaf + f" ANTI JOIN best{k} USING (node)")
        if k < depth:
            ends.append(f"SELECT node, {_NAME_SQL} AS feature, CAST(bin AS INT) AS bin, gain, 0.0 AS weight FROM best{k}")
    return sj.with_jobs("clean", extra=parts) + f"SELECT 1 AS round, CAST(node AS INT) AS node, feature, bin, {s6('gain')} AS gain, {s6('weight')} AS weight FROM (" + " UNION ALL ".join(ends) + ")"


@register("gbt_first_tree", _first_tree_sql(2))
def q_gbt_first_tree(spark, d):
    """The first tree of a second-order boosted model: splits, gains and leaf weights."""
    train, _ = _binned(spark, d)
    model = ht.boost_trees(train, LABEL, rounds=1, depth=2, l2=_L2, min_hessian=_MIN_H)
    return ht.split_table(spark, model, _TREE_COLS).withColumns({"gain": r6("gain"), "weight": r6("weight")})


@register("gbt_second_order")
def q_gbt_second_order(spark, d):
    """Test-set probabilities of a second-order boosted model (10 rounds of depth 3 here)."""
    train, test = _binned(spark, d)
    model = ht.boost_trees(train, LABEL, rounds=10, depth=3, l2=_L2, min_hessian=_MIN_H)
    return ht.boosted_probability(model, test).select("fecha", "indicativo", LABEL, "p1")


_RATE, _STUMP_ROUNDS = 0.1, 3


def _stumps_sql() -> str:
    parts = dict(_BIN_SQL)
    parts["w1"] = "SELECT id, y, 1.0 / count(*) OVER () AS w FROM tr"
    for k in range(1, _STUMP_ROUNDS + 1):
        parts[f"h{k}"] = f"SELECT c.f, c.bin, sum(CASE WHEN w.y = 0 THEN w.w ELSE 0.0 END) AS a0, sum(CASE WHEN w.y = 1 THEN w.w ELSE 0.0 END) AS a1 FROM w{k} w JOIN cell c USING (id) GROUP BY ALL"
        parts[f"c{k}"] = (f"SELECT f, bin, sum(a0) OVER w AS l0, sum(a1) OVER w AS l1, sum(a0) OVER p AS t0, sum(a1) OVER p AS t1, max(bin) OVER p AS last FROM h{k} "
                          "WINDOW w AS (PARTITION BY f ORDER BY bin), p AS (PARTITION BY f)")
        parts[f"g{k}"] = (f"SELECT *, (l0 * l0 + l1 * l1) / (l0 + l1) + ((t0 - l0) * (t0 - l0) + (t1 - l1) * (t1 - l1)) / (t0 + t1 - l0 - l1) AS score, "
                          f"CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS lft, CASE WHEN t1 - l1 > t0 - l0 THEN 1 ELSE 0 END AS rgt FROM c{k} WHERE bin < last")
        parts[f"s{k}"] = (f"SELECT f, bin, lft, rgt, error, {_RATE} * ln((1 - error) / error) AS alpha FROM (SELECT *, (CASE WHEN lft = 1 THEN l0 ELSE l1 END + CASE WHEN rgt = 1 THEN t0 - l0 ELSE t1 - l1 END) / (t0 + t1) AS error "
                          f"FROM g{k} ORDER BY round(score, 10) DESC, f, bin LIMIT 1)")
        parts[f"w{k + 1}"] = (f"SELECT id, y, v / sum(v) OVER () AS w FROM (SELECT w.id, w.y, w.w * exp(s.alpha * CASE WHEN CASE WHEN c.bin <= s.bin THEN s.lft ELSE s.rgt END <> w.y THEN 1 ELSE 0 END) AS v "
                              f"FROM w{k} w CROSS JOIN s{k} s JOIN cell c ON c.id = w.id AND c.f = s.f)")
    return sj.with_jobs("clean", extra=parts) + " UNION ALL ".join(
        f"SELECT {k} AS round, {_NAME_SQL} AS feature, CAST(bin AS INT) AS bin, lft AS label_left, rgt AS label_right, {s6('error')} AS error, {s6('alpha')} AS alpha FROM s{k}" for k in range(1, _STUMP_ROUNDS + 1))


@register("adaboost_stumps", _stumps_sql())
def q_adaboost_stumps(spark, d):
    """The first stumps of an AdaBoost model over binned features (1000 rounds by default)."""
    train, _ = _binned(spark, d)
    found = ht.boost_stumps(train, LABEL, rounds=_STUMP_ROUNDS, rate=_RATE)
    rows = [(k + 1, _TREE_COLS[s.feature], s.bin, s.left, s.right, s.error, s.alpha) for k, s in enumerate(found)]
    out = spark.createDataFrame(rows, "round int, feature string, bin int, label_left int, label_right int, error double, alpha double")
    return out.withColumns({"error": r6("error"), "alpha": r6("alpha")})


@register("job_train_eval")
def q_job_train_eval(spark, d):
    """Train a boosted model on the time split, evaluate on the test years."""
    tr, te = _prepared(spark, d)
    pred = _scored(md.gbt(max_iter=20, max_depth=5).fit(tr).transform(te))
    pred = pred.withColumns({LABEL: F.col(LABEL).cast("long"), "prediction": F.col("prediction").cast("long")})
    return ev.macro_metrics(pred, LABEL, "prediction").crossJoin(ev.log_loss(pred, LABEL, "p1"))


def _smote_input(spark, d):
    """Training rows of the time split, numeric features standardised and rounded to six places."""
    b = feat.split_time(_clean_table(spark, d), "fecha", CUTOFF)
    b = feat.standardize(b, NUMERIC).where("split = 'train'").withColumns({c: r6(c) for c in NUMERIC})
    return b.withColumn("row_key", F.concat_ws("|", F.col("indicativo").cast("string"), F.col("fecha").cast("string")))


def _hex(text: str, digits: int) -> str:
    """SQL of a number from the first hex digits of a digest."""
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


_SMOTE_K = 5
_SMOTE = {
    "sp": f"SELECT *, CASE WHEN fecha < DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS split FROM clean",
    "st": "SELECT " + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in NUMERIC) + " FROM sp WHERE split = 'train'",
    "tr": "SELECT concat_ws('|', CAST(indicativo AS VARCHAR), CAST(fecha AS VARCHAR)) AS row_key, ocurrencia, " + ", ".join(
        f"{s6(f'CASE WHEN sd_{c} > 0 THEN ({c} - mu_{c}) / sd_{c} ELSE 0.0 END')} AS {c}" for c in NUMERIC) + " FROM sp CROSS JOIN st WHERE split = 'train'",
    "sizes": "SELECT ocurrencia, count(*) AS n FROM tr GROUP BY ocurrencia",
    "want": "SELECT arg_min(ocurrencia, (n, CAST(ocurrencia AS VARCHAR))) AS label, min(n) AS n_min, max(n) - min(n) AS n_new FROM sizes",
    "mino": "SELECT tr.* FROM tr JOIN want ON tr.ocurrencia = want.label",
    "dist": "SELECT a.row_key, b.row_key AS nn_key, sqrt(" + " + ".join(["0.0", *(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NUMERIC)]) +
            ") AS d FROM mino a JOIN mino b ON a.row_key <> b.row_key WHERE " + " AND ".join(f"a.{c} IS NOT NULL AND b.{c} IS NOT NULL" for c in NUMERIC),
    "nn": f"SELECT * FROM (SELECT row_key, nn_key, row_number() OVER (PARTITION BY row_key ORDER BY d, nn_key) AS nn_rank FROM dist) WHERE nn_rank <= {_SMOTE_K}",
    "reps": f"SELECT mino.*, n_new // n_min + CASE WHEN row_number() OVER (ORDER BY {_hex(f"concat_ws('|', row_key, '{SEED}-extra')", 15)}) <= n_new % n_min THEN 1 ELSE 0 END AS n, n_min FROM mino CROSS JOIN want",
    "cop": "SELECT *, unnest(range(n)) AS copia FROM reps",
    "drawn": f"SELECT *, {_hex(f"concat_ws('|', row_key, CAST(copia AS VARCHAR), '{SEED}')", 8)} % least({_SMOTE_K}, n_min - 1) + 1 AS pick, "
             f"{_hex(f"concat_ws('|', row_key, CAST(copia AS VARCHAR), '{SEED}') || 'u'", 13)} / {float(16 ** 13)} AS u FROM cop",
}


@register("smote_counts", sj.with_jobs("clean", extra={
    "tr": f"SELECT ocurrencia FROM clean WHERE fecha < DATE '{CUTOFF}'",
    "c": "SELECT ocurrencia, count(*) AS n FROM tr GROUP BY ocurrencia"}) + """
    SELECT ocurrencia, (SELECT max(n) FROM c) AS n FROM c""")
def q_smote_counts(spark, d):
    """M3: class counts of the training rows after SMOTE (parity)."""
    b = _smote_input(spark, d)
    syn = smp.smote(b, LABEL, "row_key", NUMERIC, k=_SMOTE_K, seed=SEED)
    both = b.select(LABEL).unionByName(syn.select(LABEL))
    return both.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))


@register("smote_rows", sj.with_jobs("clean", extra=_SMOTE) + "SELECT c.row_key, CAST(c.copia AS BIGINT) AS copia, c.ocurrencia, " + ", ".join(
    f"{s6(f'c.{c} + c.u * (o.{c} - c.{c})')} AS {c}" for c in NUMERIC) +
    " FROM drawn c JOIN nn ON nn.row_key = c.row_key AND nn.nn_rank = c.pick JOIN mino o ON o.row_key = nn.nn_key")
def q_smote_rows(spark, d):
    """M3: the synthetic minority rows themselves (against every pair of minority rows in SQL)."""
    b = _smote_input(spark, d)
    return smp.smote(b, LABEL, "row_key", NUMERIC, k=_SMOTE_K, seed=SEED).withColumns({c: r6(c) for c in NUMERIC})
