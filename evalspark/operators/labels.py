"""Label tables: projection, validation against a taxonomy, encoding, audits, reports, weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import lookup
from ..functions.text import col
from .ranking import with_scalars


@dataclass(frozen=True)
class Head:
    name: str
    classes: tuple[str, ...] = ()  # empty for a regression head
    scale: float = 1.0


# Heads, their classes in index order, and the scale of regression targets.
HEADS = (
    Head("speaker_gender", ("female", "male", "unknown")),
    Head("speaker_age", ("child", "young_adult", "adult", "older_adult", "unknown")),
    Head("mood_class", ("neutral", "calm_positive", "warm", "excited", "sad", "tense", "playful")),
    Head("valence"),
    Head("arousal"),
    Head("volume", ("normal", "loud")),
    Head("pitch", ("medium", "high")),
    Head("speaking_speed", ("slow", "normal", "fast")),
    Head("snr_db", scale=90.0),
    Head("environment", ("indoor_quiet", "indoor_noisy", "outdoor", "phone_call", "unknown")),
    Head("speech_style", ("conversational", "narration", "oratorical", "dramatic", "unknown")),
    Head("voice_quality", ("voiced", "whispered")),
)
BY_NAME = {h.name: h for h in HEADS}

# Raw label -> mood class, per manifest.
MELD_MOODS = {
    "anger": "tense", "disgust": "tense", "fear": "tense", "joy": "excited", "neutral": "neutral",
    "sadness": "sad", "surprise": "excited",
}
DAILYTALK_MOODS = {
    "no emotion": "neutral", "happiness": "excited", "surprise": "excited", "sadness": "sad", "anger": "tense",
    "disgust": "tense", "fear": "tense",
}
RAVDESS_EMOTIONS = {
    "01": "neutral", "02": "calm", "03": "happy", "04": "sad", "05": "angry", "06": "fearful", "07": "disgust",
    "08": "surprised",
}
RAVDESS_MOODS = {
    "01": "neutral", "02": "calm_positive", "03": "excited", "04": "sad", "05": "tense", "06": "tense", "07": "tense",
    "08": "excited",
}
SPEAKER_GENDER = {
    "Rachel": "female", "Monica": "female", "Phoebe": "female", "Joey": "male", "Chandler": "male", "Ross": "male",
}
PITCH_MAP = {"low": "medium", "medium": "medium", "high": "high"}
VOLUME_KEEP = ("normal", "loud")


def project_attributes(df: DataFrame, remap: Mapping[str, Mapping[str, str]], keep: Mapping[str, Sequence[str]]) -> DataFrame:
    """attributes.* as flat columns with class remaps and keep-lists; unmapped classes stay as they are."""
    flat = df.select("*", "attributes.*").drop("attributes")
    for name, mapping in remap.items():
        flat = flat.withColumn(name, F.coalesce(lookup(dict(mapping), F.col(name)), F.col(name)))
    for name, classes in keep.items():
        flat = flat.filter(F.col(name).isin(*classes))
    return flat


def validate_tags(df: DataFrame, heads: Sequence[Head], tags: str = "tags") -> DataFrame:
    """Tag values outside the class list become NULL; rows marked as errors are dropped.

    ``tags`` is map<string, struct<value, confidence>>.
    """
    kept = df.filter(F.coalesce(~F.map_contains_key(tags, "_error"), F.lit(True)))
    for head in heads:
        value = F.try_element_at(F.col(tags), F.lit(head.name))["value"]
        kept = kept.withColumn(head.name, F.when(value.isin(*head.classes), value))
    return kept.drop(tags)


def map_labels(df: DataFrame, source: str, target: str, mapping: Mapping[str, str], default: str | None) -> DataFrame:
    value = lookup(dict(mapping), F.col(source))
    return df.withColumn(target, value if default is None else F.coalesce(value, F.lit(default)))


def parse_filename_fields(df: DataFrame, path: str) -> DataFrame:
    """Seven dashed parts of a file name; only speech recordings with full audio-video codes 03/01 stay."""
    name = F.replace(F.element_at(F.split(path, "/"), -1), F.lit(".wav"), F.lit(""))
    parts = df.withColumn("_p", F.split(name, "-")).filter(F.size("_p") == 7)
    p = F.col("_p")
    actor = p[6].try_cast("int")
    return (
        parts.filter((p[0] == "03") & (p[1] == "01"))
        .withColumn("raw_emotion", F.coalesce(lookup(RAVDESS_EMOTIONS, p[2]), F.lit("unknown")))
        .withColumn("mood_class", lookup(RAVDESS_MOODS, p[2]))
        .withColumn("intensity", F.when(p[3] == "02", "strong").otherwise("normal"))
        .withColumn("volume", F.when(p[3] == "02", "loud").otherwise("normal"))
        .withColumn("actor_id", actor)
        .withColumn("speaker_gender", F.when(actor % 2 == 0, "female").otherwise("male"))
        .drop("_p")
    )


def explode_supervisions(df: DataFrame, lo: float = 0.5, hi: float = 30.0) -> DataFrame:
    rows = df.select(*[c for c in df.columns if c != "supervisions"], F.explode("supervisions").alias("s"))
    return rows.filter(F.col("s.duration").between(lo, hi)).select("*", "s.*").drop("s")


def key_from_path(path) -> Column:
    """Leading id of the file stem as a number, NULL when it is none."""
    stem = F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")
    return F.element_at(F.split(stem, "-"), 1).try_cast("long")


def encode_targets(df: DataFrame, heads: Sequence[Head] = HEADS) -> DataFrame:
    """<head>_target and <head>_mask; a masked target is 0."""
    out = df
    for h in heads:
        if h.name not in df.columns:
            continue
        if h.classes:
            index = F.array_position(F.array(*[F.lit(c) for c in h.classes]), F.col(h.name)) - 1
            mask = F.coalesce(index >= 0, F.lit(False))
            target = F.when(mask, index).otherwise(F.lit(0)).cast("long")
        else:
            value = F.nanvl(F.col(h.name).cast("double"), F.lit(None).cast("double"))
            mask, target = value.isNotNull(), F.coalesce(value / h.scale, F.lit(0.0))
        out = out.withColumn(f"{h.name}_target", target).withColumn(f"{h.name}_mask", mask)
    return out


def mark_executable_tasks(df: DataFrame) -> DataFrame:
    """Tasks with a code_exec grader that has tests; its fields become columns, the prompt is untouched."""
    runnable = F.filter("graders", lambda g: (g["type"] == "code_exec") & (F.coalesce(F.array_size(g["tests"]), F.lit(0)) > 0))
    first = F.try_element_at(runnable, F.lit(1))
    return (
        df.withColumn("_g", first).filter(F.col("_g").isNotNull())
        .select(
            *[c for c in df.columns if c != "graders"],
            F.col("_g.tests").alias("tests"), F.col("_g.entry").alias("entry"),
            F.coalesce("_g.setup", F.lit("")).alias("setup"), F.coalesce("_g.timeout", F.lit(10)).alias("timeout"),
            F.concat_ws("#", "suite", "id").alias("source"),
        )
    )


# --- audits and reports ------------------------------------------------------------------------

def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count per value of every column, NULL as a value of its own. One scan for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def audit_numeric(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, min, mean, max per group and in total (NULL group)."""
    return df.rollup(by).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"))


def _grid(spark, heads: Mapping[str, Sequence]) -> DataFrame:
    rows = [(h, str(a), str(b)) for h, classes in heads.items() for a in classes for b in classes]
    return spark.createDataFrame(rows, "head string, truth string, pred string")


def confusion(preds: DataFrame, classes: Mapping[str, Sequence]) -> DataFrame:
    """Counts by (head, truth, pred): the full class grid, and every other pair that occurs. Rows without a truth are
    masked; a NULL prediction stays NULL.

    preds has head, truth, pred; the grid has classes^2 rows per head.
    """
    seen = preds.filter(F.col("truth").isNotNull()).groupBy(
        "head", F.col("truth").cast("string").alias("truth"), F.col("pred").cast("string").alias("pred")
    ).agg(F.count(F.lit(1)).alias("n"))
    both = _grid(preds.sparkSession, classes).withColumn("n", F.lit(0).cast("long")).unionByName(seen)
    return both.groupBy("head", "truth", "pred").agg(F.sum("n").alias("n"))


def classification_report(preds: DataFrame, classes: Mapping[str, Sequence], present_only: bool = False) -> DataFrame:
    """accuracy, macro F1 over all declared classes, n. Absent classes count as F1 = 0 by default.

    Every row with a truth counts in n, accuracy and support: a missing or foreign prediction is a wrong one.
    """
    cells = confusion(preds, classes)
    named = F.create_map(*[x for h, cs in classes.items() for x in (F.lit(h), F.array(*[F.lit(str(c)) for c in cs]))])
    sides = cells.select("head", "n", F.explode(F.array(
        F.struct(F.col("truth").alias("cls"), F.lit("t").alias("side"), F.coalesce(F.col("truth") == F.col("pred"), F.lit(False)).alias("hit")),
        F.struct(F.col("pred").alias("cls"), F.lit("p").alias("side"), F.lit(False).alias("hit")),
    )).alias("s"))
    per_class = sides.groupBy("head", "s.cls").agg(
        F.sum(F.when(F.col("s.hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.side") == "t", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
    )
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)), F.lit(0.0))
    declared = F.coalesce(F.array_contains(F.try_element_at(named, F.col("head")), F.col("cls")), F.lit(False))
    counted = declared & (F.col("support") > 0) if present_only else declared
    return per_class.groupBy("head").agg(
        F.round(F.sum("tp") / F.nullif(F.sum("support"), F.lit(0)), 6).alias("accuracy"),
        F.round(F.avg(F.when(counted, f1)), 6).alias("f1_macro"), F.sum("support").alias("n"),
    )


def regression_report(df: DataFrame, by: str, truth: str, pred: str) -> DataFrame:
    gap = F.col(pred).cast("double") - F.col(truth).cast("double")
    return df.filter(F.col(truth).isNotNull()).groupBy(by).agg(
        F.round(F.avg(F.abs(gap)), 6).alias("mae"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"),
        F.count(F.lit(1)).alias("n"))


def majority_baseline(train: DataFrame, test: DataFrame, heads: Sequence[Head]) -> DataFrame:
    """Most common train class (lowest index on ties) or train mean, scored on the test rows.

    Returns head, kind, accuracy, f1_macro, mae, n.
    """
    out = None
    for h in heads:
        if h.classes:
            order = F.create_map(*[x for i, c in enumerate(h.classes) for x in (F.lit(str(c)), F.lit(-i))])
            votes = train.select(F.col(h.name).cast("string").alias("c")).filter(F.col("c").isin(*map(str, h.classes)))
            modal = votes.groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(
                F.max_by("c", F.struct("n", F.try_element_at(order, F.col("c")))).alias("pred"))
            preds = with_scalars(test.select(F.lit(h.name).alias("head"), F.col(h.name).cast("string").alias("truth")), modal)
            valid = preds.filter(F.col("truth").isin(*map(str, h.classes)))
            part = classification_report(valid, {h.name: h.classes}).select(
                "head", F.lit("classification").alias("kind"), "accuracy", "f1_macro", F.lit(None).cast("double").alias("mae"), "n")
        else:
            mean = train.agg(F.avg(h.name).alias("pred"))
            preds = with_scalars(test.select(F.lit(h.name).alias("head"), F.col(h.name).alias("truth")), mean)
            part = regression_report(preds, "head", "truth", "pred").select(
                "head", F.lit("regression").alias("kind"), F.lit(None).cast("double").alias("accuracy"),
                F.lit(None).cast("double").alias("f1_macro"), "mae", "n")
        out = part if out is None else out.unionByName(part)
    return out


def linear_probe(train: DataFrame, test: DataFrame, features: str, target: str, classes: int = 0,
                 least: int = 20, reg: float = 1.0) -> DataFrame | None:
    """Predictions of a logistic (classes > 0) or ridge probe on fixed vectors; None when train is too small."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    def prepared(df):
        rows = df.filter(F.col(target).isNotNull())
        return rows.withColumn("_x", array_to_vector(F.col(features).cast("array<double>"))).withColumn("_y", F.col(target).cast("double"))

    fit = prepared(train)
    size = fit.agg(F.count(F.lit(1)).alias("n"), (F.min("_y") != F.max("_y")).alias("varied")).first()
    if size["n"] < least or (classes and not size["varied"]):
        return None
    if classes:
        # a unit penalty on summed loss is 1/n on the mean loss used here
        model = LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="pred", maxIter=500,
                                   regParam=reg / size["n"], elasticNetParam=0.0, standardization=False)
    else:
        model = LinearRegression(featuresCol="_x", labelCol="_y", predictionCol="pred",
                                 regParam=reg / size["n"], elasticNetParam=0.0, standardization=False)
    scored = model.fit(fit).transform(prepared(test))
    kind = "long" if classes else "double"
    return scored.select(F.col("_y").cast(kind).alias("truth"), F.col("pred").cast(kind).alias("pred"))


def class_weights(df: DataFrame, head: Head, power: float = 1.0) -> DataFrame:
    """Inverse frequency to a power, absent classes 0, scaled to mean 1 over the declared classes."""
    k = len(head.classes)
    grid = df.sparkSession.createDataFrame([(str(c),) for c in head.classes], "cls string")
    seen = df.groupBy(F.col(head.name).cast("string").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    counts = grid.join(seen, "cls", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.sum("n").alias("_total"))
    raw = with_scalars(counts, total).withColumn(
        "_w", F.when(F.col("n") > 0, F.pow(F.col("_total") / (F.col("n") * k), F.lit(power))).otherwise(F.lit(0.0)))
    scale = raw.agg(F.sum("_w").alias("_sum"))
    return with_scalars(raw, scale).select(
        F.lit(head.name).alias("head"), "cls", "n", F.round(F.col("_w") * k / F.col("_sum"), 6).alias("weight"))


def balanced_sample_weights(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """weight = product of 1/count over the columns; NULL takes the mean weight of its column.

    Counts are joined back as small tables, so no value is ever gathered in one task.
    """
    out, weight = df, F.lit(1.0)
    for c in columns:
        n = f"_n_{c}"
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(n))
        mean = counts.agg((F.count(F.lit(1)).cast("double") / F.sum(n)).alias(f"_m_{c}"))
        out = with_scalars(out.join(counts, c, "left"), mean)
        weight = weight * F.coalesce(1.0 / F.col(n), F.col(f"_m_{c}"))
    return out.withColumn("weight", weight).select(*df.columns, "weight")
