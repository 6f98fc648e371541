"""Label tables, their joins, audits and reports, derived from events, labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, tables
from ..operators.labels import BY_NAME, Head
from .registry import Tables, query
from .views import SQL_PREDICTIONS, predictions

STYLES = ("conversational", "narration", "singing", "dramatic")
PLACES = ("indoor_quiet", "outdoor", "spaceship")
MOODS = ("neutral", "angry", "warm", "sad", "tense")


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def audio_path():
    e = F.col("event_id").cast("string")
    return F.concat(F.lit("/data/"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 97).cast("string"),
                    F.lit("-"), e, F.lit(".flac"))


def manifest_rows(t: Tables):
    e, u = F.col("event_id"), F.col("user_id")
    return t.events.select(
        audio_path().alias("audio_path"),
        F.struct(
            F.col("value").alias("duration"), pick(("quiet", "normal", "loud"), e).alias("volume"),
            pick(("low", "medium", "high"), u).alias("pitch"), pick(("slow", "normal", "fast"), (e / 7).cast("long")).alias("speaking_speed"),
            (F.col("value") / 4).alias("snr_db"), (F.col("value") / 1000).alias("rms"),
        ).alias("attributes"),
    )


def attrs(t: Tables):
    return labels.project_attributes(manifest_rows(t), {"pitch": labels.PITCH_MAP}, {"volume": labels.VOLUME_KEEP})


SQL_ATTRS = """attrs0 as (select event_id, user_id, value, '/data/' || user_id || '-' || (event_id % 97) || '-' || event_id || '.flac' as audio_path, value as duration,
  ['quiet','normal','loud'][(event_id % 3 + 1)::int] as volume, ['medium','medium','high'][(user_id % 3 + 1)::int] as pitch,
  ['slow','normal','fast'][((event_id // 7) % 3 + 1)::int] as speaking_speed, value / 4 as snr_db, value / 1000 as rms from events),
attrs as (select * from attrs0 where volume in ('normal','loud'))"""


def tag_rows(t: Tables):
    e = F.col("event_id")

    def tag(name, value):
        return F.lit(name), F.struct(value.alias("value"), F.lit(0.9).alias("confidence"))

    base = F.create_map(*tag("speech_style", pick(STYLES, e)), *tag("environment", pick(PLACES, e)), *tag("mood_class", pick(MOODS, e)))
    error = F.create_map(*tag("_error", F.lit("timeout")))
    return t.events.filter(e % 4 != 0).select(
        audio_path().alias("audio_path"), F.when(e % 17 == 0, F.map_concat(base, error)).otherwise(base).alias("tags"))


def prose(t: Tables):
    return labels.validate_tags(tag_rows(t), [BY_NAME[n] for n in ("speech_style", "environment", "mood_class")])


SQL_PROSE = """prose as (select '/data/' || user_id || '-' || (event_id % 97) || '-' || event_id || '.flac' as audio_path,
  [ 'conversational','narration',null,'dramatic'][(event_id % 4 + 1)::int] as speech_style,
  ['indoor_quiet','outdoor',null][(event_id % 3 + 1)::int] as environment,
  ['neutral',null,'warm','sad','tense'][(event_id % 5 + 1)::int] as mood_class from events where event_id % 4 <> 0 and event_id % 17 <> 0)"""


@query("N23_project_attributes", f"with {SQL_ATTRS} select audio_path, duration, volume, pitch, speaking_speed, snr_db, rms from attrs")
def _(t: Tables):
    return attrs(t)


@query("N24_validate_tags", f"with {SQL_PROSE} select audio_path, speech_style, environment, mood_class from prose")
def _(t: Tables):
    return prose(t)


@query("N25_map_labels", """
select event_id, case event_type when 'click' then 'tense' when 'view' then 'excited' when 'purchase' then 'sad' else 'neutral' end as mood_class,
  case event_type when 'signup' then 'female' when 'error' then 'male' else 'unknown' end as speaker_gender, 'conversational' as speech_style from events""")
def _(t: Tables):
    rename = {"click": "anger", "view": "joy", "purchase": "sadness"}
    speaker = {"signup": "Monica", "error": "Ross"}
    rows = labels.map_labels(t.events.select("event_id", "event_type"), "event_type", "emotion", rename, "shrug")
    rows = labels.map_labels(rows, "event_type", "speaker", speaker, "guest")
    rows = labels.map_labels(rows, "emotion", "mood_class", labels.MELD_MOODS, "neutral")
    rows = labels.map_labels(rows, "speaker", "speaker_gender", labels.SPEAKER_GENDER, "unknown")
    return rows.select("event_id", "mood_class", "speaker_gender", F.lit("conversational").alias("speech_style"))


def recordings(t: Tables):
    e = F.col("event_id")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    name = F.concat_ws("-", two(3 - e % 2), two(1 + e % 3), two(1 + e % 9), two(1 + (e / 3).cast("long") % 2), F.lit("01"), F.lit("02"),
                       two(1 + F.col("user_id") % 24))
    full = F.when(e % 11 == 0, F.concat(name, F.lit("-x"))).otherwise(name)
    return t.events.select("event_id", F.concat(F.lit("/rec/a/"), full, F.lit(".wav")).alias("path"))


@query("N26_parse_filename_fields", """
select event_id, ['neutral','calm','happy','sad','angry','fearful','disgust','surprised','unknown'][(event_id % 9 + 1)::int] as raw_emotion,
  ['neutral','calm_positive','excited','sad','tense','tense','tense','excited',null][(event_id % 9 + 1)::int] as mood_class,
  case when (event_id // 3) % 2 = 1 then 'strong' else 'normal' end as intensity, case when (event_id // 3) % 2 = 1 then 'loud' else 'normal' end as volume,
  (1 + user_id % 24)::bigint as actor_id, case when (1 + user_id % 24) % 2 = 0 then 'female' else 'male' end as speaker_gender
from events where event_id % 11 <> 0 and event_id % 2 = 0 and event_id % 3 = 0""")
def _(t: Tables):
    return labels.parse_filename_fields(recordings(t), "path").drop("path").withColumn("actor_id", F.col("actor_id").cast("long"))


@query("N27_explode_supervisions", """
select l_orderkey as cut_id, l_linenumber::bigint as pos, l_quantity / 10 as duration, l_returnflag as emotion from lineitem where l_quantity / 10 between 0.5 and 3.5""")
def _(t: Tables):
    sup = F.struct(F.col("l_linenumber").cast("long").alias("pos"), (F.col("l_quantity") / 10).alias("duration"), F.col("l_returnflag").alias("emotion"))
    cuts = t.lineitem.groupBy(F.col("l_orderkey").alias("cut_id")).agg(F.collect_list(sup).alias("supervisions"))
    return labels.explode_supervisions(cuts, 0.5, 3.5)


@query("N28_key_from_path", """
select event_id, case when event_id % 10 = 0 then null else user_id end as speaker_id from events""")
def _(t: Tables):
    path = F.when(F.col("event_id") % 10 == 0, F.lit("/data/spk-1-2.flac")).otherwise(audio_path())
    return t.events.select("event_id", labels.key_from_path(path).alias("speaker_id"))


def label_table(t: Tables):
    return tables.enrich_labels(attrs(t), prose(t), "audio_path")


SQL_LABELS = f"{SQL_ATTRS}, {SQL_PROSE}, lab as (select a.*, p.speech_style, p.environment, p.mood_class from attrs a left join prose p using (audio_path))"


@query("N29_encode_targets", f"""with {SQL_LABELS} select audio_path,
  case volume when 'loud' then 1 else 0 end::bigint as volume_target, volume in ('normal','loud') as volume_mask,
  coalesce(case mood_class when 'neutral' then 0 when 'warm' then 2 when 'sad' then 4 when 'tense' then 5 end, 0)::bigint as mood_class_target, mood_class is not null as mood_class_mask,
  round(snr_db / 90, 9) as snr_db_target, true as snr_db_mask from lab""")
def _(t: Tables):
    out = labels.encode_targets(label_table(t), [BY_NAME[n] for n in ("volume", "mood_class", "snr_db")])
    return out.select("audio_path", "volume_target", "volume_mask", "mood_class_target", "mood_class_mask",
                      F.round("snr_db_target", 9).alias("snr_db_target"), "snr_db_mask")


@query("N30_mark_executable_tasks", """
select o_orderkey as id, o_orderpriority as prompt, 'assert ' || o_orderkey as tests, 'solve' as entry, '' as setup, 10::bigint as timeout,
  o_orderstatus || '#' || o_orderkey as source from orders where o_orderkey % 4 <> 0 and o_orderkey % 3 <> 0""")
def _(t: Tables):
    k = F.col("o_orderkey")
    tests = F.when(k % 3 != 0, F.array(F.concat(F.lit("assert "), k)))
    none = F.lit(None).cast("string")
    judge = F.struct(F.lit("judge").alias("type"), F.lit(None).cast("array<string>").alias("tests"), none.alias("entry"), none.alias("setup"), F.lit(None).cast("int").alias("timeout"))
    code = F.struct(F.when(k % 4 == 0, "match").otherwise("code_exec").alias("type"), tests.alias("tests"), F.lit("solve").alias("entry"), none.alias("setup"), F.lit(None).cast("int").alias("timeout"))
    rows = t.orders.select(k.alias("id"), F.col("o_orderstatus").alias("suite"), F.col("o_orderpriority").alias("prompt"), F.array(judge, code).alias("graders"))
    return labels.mark_executable_tasks(rows).select(
        "id", "prompt", F.array_join("tests", ";").alias("tests"), "entry", "setup", F.col("timeout").cast("long").alias("timeout"), "source")


# --- joins ---------------------------------------------------------------------------------------

@query("J1_enrich_labels", f"with {SQL_LABELS} select audio_path, volume, pitch, speech_style, environment, mood_class from lab")
def _(t: Tables):
    return label_table(t).select("audio_path", "volume", "pitch", "speech_style", "environment", "mood_class")


@query("J2_lookup_dim", """
select e.event_id, e.user_id, coalesce(case when c.c_acctbal >= 0 then c.c_mktsegment end, 'unknown') as segment
from events e left join customer c on c.c_custkey = e.user_id and c.c_acctbal >= 5000""")
def _(t: Tables):
    dim = t.customer.filter("c_acctbal >= 5000").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return tables.lookup_dim(t.events.select("event_id", "user_id"), dim, "user_id", "segment")


@query("J3_inherit_parent", f"""with {SQL_ATTRS}, child as (select audio_path || '.w' as audio_path, audio_path as voiced_source, 'whispered' as voice_quality from attrs0 where event_id % 5 = 0)
select audio_path, user_id as speaker_id, duration, volume, 'voiced' as voice_quality from attrs
union all select c.audio_path, a.user_id, a.duration, null, c.voice_quality from child c left join attrs a on a.audio_path = c.voiced_source""")
def _(t: Tables):
    parent = attrs(t).select("audio_path", labels.key_from_path("audio_path").alias("speaker_id"), "duration", "volume", F.lit("voiced").alias("voice_quality"))
    child = t.events.filter("event_id % 5 = 0").select(
        F.concat(audio_path(), F.lit(".w")).alias("audio_path"), audio_path().alias("voiced_source"), F.lit("whispered").alias("voice_quality"))
    return tables.inherit_parent(parent, child, "audio_path", "voiced_source", ["speaker_id", "duration"])


@query("J4_inner_on_keys", """
with a as (select o_custkey as k, o_orderkey as v from orders where o_orderstatus = 'F' qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1),
b as (select o_custkey as k, o_orderkey as w from orders where o_orderstatus = 'O' qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)
select k, v as chosen, w as rejected from a join b using (k)""")
def _(t: Tables):
    def side(status, name):
        o = t.orders.filter(F.col("o_orderstatus") == status)
        return o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias(name))

    return tables.inner_on_keys(side("F", "chosen"), side("O", "rejected"), "k", "ord")


@query("J5_intersect_ids", """
select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'
intersect select o_custkey from orders where o_orderstatus = 'P'""")
def _(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return tables.intersect_ids("k", [o.filter(F.col("o_orderstatus") == s).select("k") for s in ("F", "O", "P")])


@query("J6_pending", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def _(t: Tables):
    return tables.pending(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("J7_semi_holdout", """
select part, count(*) as n, sum(n_chars)::bigint as chars from (select n_chars, case when doc_id in (select doc_id from labels where toxic = 1) then 'held' else 'rest' end as part from documents) group by part""")
def _(t: Tables):
    inside, outside = tables.semi_holdout(t.documents.select("doc_id", "n_chars"), t.labels.filter("toxic = 1"), "doc_id")
    both = inside.withColumn("part", F.lit("held")).unionByName(outside.withColumn("part", F.lit("rest")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("J8_union_by_name", """
select 'c' as origin, cast(c_custkey as varchar) as speaker_id, c_mktsegment as segment, null as brand from customer
union all select 'p', p_name, null, p_brand from part""")
def _(t: Tables):
    a = t.customer.select(F.lit("c").alias("origin"), F.col("c_custkey").alias("speaker_id"), F.col("c_mktsegment").alias("segment"))
    b = t.part.select(F.lit("p").alias("origin"), F.col("p_name").alias("speaker_id"), F.col("p_brand").alias("brand"))
    return tables.union_by_name([a, b], as_text=["speaker_id"])


# --- audits and reports -----------------------------------------------------------------------------

@query("A14_value_counts", f"""with {SQL_LABELS}, u as (
  select 'volume' as "column", volume as value from lab union all select 'pitch', pitch from lab union all select 'speech_style', speech_style from lab
  union all select 'mood_class', mood_class from lab)
select "column", value, count(*) as n from u group by 1, 2""")
def _(t: Tables):
    return labels.value_counts(label_table(t), ["volume", "pitch", "speech_style", "mood_class"])


@query("A15_audit_numeric", f"""with {SQL_ATTRS} select volume, count(snr_db) as n, min(snr_db) as min, round(avg(snr_db), 6) as mean, max(snr_db) as max
from attrs group by rollup(volume)""")
def _(t: Tables):
    return labels.audit_numeric(attrs(t), "volume", "snr_db")


QUALITY = {"quality": (0, 1)}
TOXIC_SQL = "tox as (select l.doc_id, l.toxic as truth, case when l.doc_id % 11 = 0 then null when l.doc_id % 13 = 0 then 7 when d.lang = 'de' then 1 else 0 end as pred from labels l join documents d using (doc_id))"


def two_heads(t: Tables):
    p = predictions(t).select(F.lit("quality").alias("head"), "truth", "pred")
    docs = t.documents.select("doc_id", "lang")
    tox = t.labels.join(docs, "doc_id").select(F.lit("toxic").alias("head"), F.col("toxic").alias("truth"), F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 13 == 0, 7).when(F.col("lang") == "de", 1).otherwise(0).alias("pred"))
    return p.unionByName(tox)


SQL_HEADS = f"{SQL_PREDICTIONS}, {TOXIC_SQL}, both_heads as (select 'quality' as head, truth, pred from pred union all select 'toxic', truth, pred from tox)"
CLASSES = {"quality": (0, 1, 2), "toxic": (0, 1)}


@query("A17_confusion", f"""with {SQL_HEADS}, classes(head, c) as (values ('quality',0),('quality',1),('quality',2),('toxic',0),('toxic',1)),
grid as (select a.head, a.c as truth, b.c as pred, 0 as n from classes a join classes b on a.head = b.head),
every as (select * from grid union all select head, truth, pred, 1 from both_heads where truth is not null)
select head, cast(truth as varchar) as truth, cast(pred as varchar) as pred, sum(n)::bigint as n from every group by 1, 2, 3""")
def _(t: Tables):
    return labels.confusion(two_heads(t), CLASSES)


@query("A18_classification_report", f"""with {SQL_HEADS}, classes(head, c) as (values ('quality',0),('quality',1),('quality',2),('toxic',0),('toxic',1)),
f as (select c.head, c.c, sum(case when p.truth = c.c and p.pred = c.c then 1 else 0 end) as tp, sum(case when p.truth = c.c then 1 else 0 end) as sup,
  sum(case when p.pred = c.c then 1 else 0 end) as prd from classes c join both_heads p on p.head = c.head group by 1, 2),
g as (select head, count(*) as n, count(*) filter (where truth = pred) as hits from both_heads where truth is not null group by 1)
select head, round(any_value(hits / n), 6) as accuracy, round(avg(coalesce(2.0::double * tp / nullif(sup + prd, 0), 0)), 6) as f1_macro, any_value(n) as n from f join g using (head) group by head""")
def _(t: Tables):
    return labels.classification_report(two_heads(t), CLASSES)


@query("A19_regression_report", f"""with {SQL_PREDICTIONS} select lang, round(avg(abs(pred * 1000 - n_chars)), 6) as mae,
  round(sqrt(avg(power(pred * 1000 - n_chars, 2))), 6) as rmse, count(*) as n from pred group by lang""")
def _(t: Tables):
    rows = predictions(t).select("lang", "n_chars", (F.col("pred") * 1000).alias("guess"))
    return labels.regression_report(rows, "lang", "n_chars", "guess")


@query("A20_majority_baseline", f"""with {SQL_LABELS}, split as (select *, user_id % 5 = 0 as is_test from lab),
modal as (select 'volume' as head, (select volume from split where not is_test group by volume order by count(*) desc, case volume when 'normal' then 0 else 1 end limit 1) as pred
  union all select 'mood_class', (select mood_class from split where not is_test and mood_class is not null group by 1
    order by count(*) desc, case mood_class when 'neutral' then 0 when 'warm' then 2 when 'sad' then 4 else 5 end limit 1)),
truths as (select 'volume' as head, volume as truth from split where is_test union all select 'mood_class', mood_class from split where is_test and mood_class is not null),
acc as (select t.head, count(*) as n, sum(case when t.truth = m.pred then 1 else 0 end) as tp from truths t join modal m using (head) group by 1)
select head, 'classification' as kind, round(tp / n, 6) as accuracy, round((2.0::double * tp / (tp + n)) / case head when 'volume' then 2 else 7 end, 6) as f1_macro, null::double as mae, n from acc
union all select 'snr_db', 'regression', null, null, round(avg(abs(snr_db - (select avg(snr_db) from split where not is_test))), 6), count(*) from split where is_test""")
def _(t: Tables):
    rows = label_table(t).withColumn("_test", labels.key_from_path("audio_path") % 5 == 0)
    train, test = rows.filter(~F.col("_test")), rows.filter("_test")
    return labels.majority_baseline(train, test, [BY_NAME[n] for n in ("volume", "mood_class", "snr_db")])


@query("A21_linear_probe")
def _(t: Tables):
    rows = t.embeddings.select("vec_id", "embedding", "label")
    held = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    preds = labels.linear_probe(rows.filter(~held), rows.filter(held), "embedding", "label", classes=10)
    return labels.classification_report(preds.withColumn("head", F.lit("label")), {"label": range(10)})


@query("A22_class_weights", f"""with {SQL_LABELS}, classes(cls) as (values ('neutral'),('calm_positive'),('warm'),('excited'),('sad'),('tense'),('playful')),
c as (select cls, count(mood_class) as n from classes left join lab on mood_class = cls group by 1),
w as (select *, case when n > 0 then power(sum(n) over () / (n * 7.0), 0.5) else 0.0::double end as w from c)
select 'mood_class' as head, cls, n, round(w * 7 / sum(w) over (), 6) as weight from w""")
def _(t: Tables):
    return labels.class_weights(label_table(t), BY_NAME["mood_class"], 0.5)


@query("A23_balanced_sample_weights", f"""with {SQL_LABELS}, s as (select speaking_speed as v, count(*) as c from lab where speaking_speed is not null group by 1),
m as (select mood_class as v, count(*) as c from lab where mood_class is not null group by 1)
select audio_path, round((1.0::double / s.c) * coalesce(1.0::double / m.c, (select count(*) / sum(c) from m)) * 1e6, 6) as weight
from lab left join s on s.v = lab.speaking_speed left join m on m.v = lab.mood_class""")
def _(t: Tables):
    out = labels.balanced_sample_weights(label_table(t), ["speaking_speed", "mood_class"])
    return out.select("audio_path", F.round(F.col("weight") * 1e6, 6).alias("weight"))
