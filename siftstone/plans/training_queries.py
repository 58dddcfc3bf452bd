"""Queries of sampling, windows, augmentation, vectors, evaluation and the bundled scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions.derive import label_id, parameter_count
from siftstone.functions.dictionaries import LABEL_NAMES
from siftstone.operators import augment, evaluate, sampling, scorer, vectors, windows
from siftstone.plans import sqlparts as S
from siftstone.plans.audit_queries import _PARAMETERS, _TOKENS, blocks, code_token_counts, preserved_tokens
from siftstone.plans.audit_queries import ORACLE as AUDIT_SQL
from siftstone.plans.scratch import scratch_path
from siftstone.sources.requests import read_cache, write_cache
from siftstone.sources.tables import table

CHUNKS, BATCH, REPEATS, RAW_REPEATS = 40, 8, 4, 12
#: Small fixed weights of the attention pooling query.
HIDDEN = [[((j * 7 + i * 3) % 11 - 5) / 50 for i in range(64)] for j in range(4)]
BIAS, OUT = [0.1, -0.1, 0.05, 0.0], [1.0, -0.5, 0.25, 2.0]
CLASS_WEIGHTS = [0.25, 1.0, 1.5, 2.0, 1.25, 0.75, 0.5, 1.0]
STEPS, PEAK = 1000, 2e-5


def _labelled(spark, d):
    return table(spark, d, "dataset_ml_ready", "sample_id", "cwe_id").select("sample_id", label_id(F.col("cwe_id")).cast("bigint").alias("label_id"))


def reduce_sample(spark, d):
    """30 percent of each chunk of the corpus, parameters counted."""
    rows = table(spark, d, "dataset_ml_ready", "sample_id", "parameters", "programming_language", "nloc", "cwe_id")
    return sampling.reduce_by_chunk(rows, "sample_id").withColumn("parameters_count", parameter_count(F.col("parameters"))).drop("parameters")


def stratified_split(spark, d):
    """Each row's part after a stratified split."""
    return sampling.stratified_split(_labelled(spark, d), "label_id", "sample_id")


def class_weights(spark, d):
    """Weights of the labels."""
    return sampling.class_weights(_labelled(spark, d))


def sampler_weights(spark, d):
    """Sampling weight of each row."""
    return sampling.sampler_weights(_labelled(spark, d), "label_id").select("sample_id", F.round("weight", 9).alias("weight"))


def weighted_resample(spark, d):
    """As many draws with replacement as rows, labels balanced."""
    return sampling.weighted_resample(_labelled(spark, d), "label_id", "sample_id")


def chunk_assign(spark, d):
    """40 nearly equal chunks."""
    rows = sampling.numbered(table(spark, d, "dataset_ml_ready", "sample_id"), "sample_id")
    total = table(spark, d, "dataset_ml_ready", "sample_id").agg(F.count("*")).scalar()
    return rows.withColumn("__n", total).select("sample_id", sampling.chunk_of(F.col("place"), F.col("__n"), CHUNKS).alias("chunk"))


def batching(spark, d):
    """Batches of eight in a shuffled order."""
    rows = sampling.numbered(table(spark, d, "dataset_ml_ready", "sample_id"), "sample_id")
    return rows.select("sample_id", F.expr(f"place div {BATCH}").alias("batch"), (F.col("place") % BATCH).alias("slot"))


def corpus(spark, d):
    """The rows of the training corpus as blocks; null code has none."""
    return table(spark, d, "dataset_ml_ready", "sample_id", "code").where("code is not null").withColumnRenamed("sample_id", "payload_id")


def _tokens(spark, d, source, repeats=1):
    return source(spark, d).select("payload_id", windows.code_tokens(F.repeat("code", F.lit(repeats)) if repeats > 1 else F.col("code")).alias("tokens"))


def _windows(df):
    return df.select("payload_id", "window_no", "start", "n_tokens", F.md5(F.array_join("window", " ")).alias("digest"))


def sliding_windows(spark, d, source=blocks):
    """Windows of each file, training form."""
    return _windows(windows.token_windows(_tokens(spark, d, source), ["payload_id"]))


def sliding_windows_infer(spark, d):
    """Windows of each file, inference form."""
    return _windows(windows.token_windows(_tokens(spark, d, blocks), ["payload_id"], policy="inference"))


def sampled_windows(spark, d, source=blocks):
    """Windows of each file's code written four times, so that many are sampled."""
    return _windows(windows.token_windows(_tokens(spark, d, source, REPEATS), ["payload_id"]))


def sampled_windows_raw(spark, d, source=blocks):
    """Raw pieces of each file's code written twelve times."""
    rows = windows.raw_windows(source(spark, d).withColumn("code", F.repeat("code", F.lit(RAW_REPEATS))), ["payload_id"])
    return rows.select("payload_id", "window_no", "start", F.md5("chunk").alias("digest"))


def build_window(spark, d, source=blocks):
    """Padded input of each file's first window."""
    ids = F.transform(F.slice("tokens", 1, windows.WIDTH), windows.token_id)
    rows = _tokens(spark, d, source).select("payload_id", windows.built(ids).alias("w"))
    return rows.select("payload_id", F.md5(F.array_join(F.transform("w.input_ids", lambda x: x.cast("string")), ",")).alias("digest"), F.aggregate("w.attention_mask", F.lit(0), lambda s, x: s + x).cast("bigint").alias("n_real"))


def ragged_offsets(spark, d, source=blocks):
    """Where each file's windows begin in its batch."""
    counted = _tokens(spark, d, source).select("payload_id", windows.window_count(F.size("tokens")).cast("bigint").alias("n_windows"))
    placed = sampling.numbered(counted, "payload_id").withColumn("batch", F.expr(f"place div {BATCH}"))
    return windows.ragged_offsets(placed, "payload_id", "batch", "n_windows").select("payload_id", "batch", "n_windows", "offset")


def cache_roundtrip(spark, d, source=blocks):
    """Windows written as parts and read again."""
    path = scratch_path(spark, "cache")
    write_cache(sliding_windows(spark, d, source).select("payload_id", "window_no", "n_tokens"), path, 8)
    return read_cache(spark, path)


def _code(spark, d, source):
    return source(spark, d).select("payload_id", "code")


def rename_candidates(spark, d, source=blocks):
    """The ten most used identifiers of each file."""
    return augment.rename_candidates(_code(spark, d, source), "payload_id")


def rename_map(spark, d, source=blocks):
    """New names of the identifiers that are renamed."""
    return augment.rename_map(_code(spark, d, source), "payload_id")


def augmented(spark, d, source=blocks):
    """Augmented code of each file."""
    return augment.augmented(_code(spark, d, source), "payload_id").select("payload_id", "changed", F.md5("code").alias("digest"))


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def pool_max(spark, d):
    """Element-wise maximum of each label's vectors."""
    return vectors.pooled(_vectors(spark, d), "label", "embedding", "max").select("label", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def pool_mean(spark, d):
    """Element-wise mean of each label's vectors."""
    return vectors.pooled(_vectors(spark, d), "label", "embedding", "mean").select("label", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def pool_attention(spark, d):
    """Attention-weighted mean of each label's vectors."""
    out = vectors.attention_pooled(_vectors(spark, d), "label", "embedding", HIDDEN, BIAS, OUT)
    return out.select("label", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def _logits(spark, d):
    logits = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    return _vectors(spark, d).select("vec_id", logits.alias("logits"), (F.col("label") % 8).cast("bigint").alias("truth"))


def softmax_predict(spark, d):
    """Label, confidence and probabilities of each vector's logits."""
    rows = _logits(spark, d).select("vec_id", vectors.softmax(F.col("logits")).alias("p")).select("vec_id", vectors.prediction(F.col("p")).alias("y"))
    return rows.select("vec_id", "y.label", F.round("y.confidence", 6).alias("confidence"), F.round(F.element_at("y.probabilities", F.lit("Other")), 6).alias("p_other"))


def predict_top3(spark, d):
    """The three most likely labels of each vector, with a bar."""
    top = vectors.top_entries(vectors.softmax(F.col("logits")), 3)
    rows = _logits(spark, d).select("vec_id", F.posexplode(top).alias("place", "e"))
    p = F.col("e.probability")
    return rows.select("vec_id", F.col("place").cast("bigint").alias("place"), "e.label", F.round(p, 6).alias("probability"), F.repeat(F.lit("█"), (p * 20).cast("int")).alias("bar"))


def focal_loss(spark, d):
    """Mean focal loss, without and with class weights."""
    rows = _logits(spark, d)
    plain, heavy = vectors.focal_loss(F.col("logits"), F.col("truth")), vectors.focal_loss(F.col("logits"), F.col("truth"), weights=CLASS_WEIGHTS)
    return rows.agg(F.round(F.avg(plain), 6).alias("loss"), F.round(F.avg(heavy), 6).alias("weighted_loss"))


def lr_schedule(spark, d):
    """Learning rate (in millionths) at every step."""
    return spark.range(STEPS).select(F.col("id").alias("step"), F.round(vectors.cosine_rate(F.col("id"), STEPS, PEAK) * 1e6, 6).alias("rate"))


def _guesses(spark, d):
    return _logits(spark, d).select("vec_id", "truth", vectors.argmax(F.col("logits")).alias("guess"), "logits")


def eval_overall(spark, d):
    """Accuracy and macro F1."""
    rows = evaluate.overall(evaluate.confusion(_guesses(spark, d), "truth", "guess"))
    return rows.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def eval_report(spark, d):
    """Precision, recall, F1 and support per label, macro and weighted."""
    rows = evaluate.full_report(evaluate.confusion(_guesses(spark, d), "truth", "guess"))
    return rows.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def eval_loss(spark, d):
    """Mean over batches of the mean loss of a batch."""
    rows = _logits(spark, d).select(F.expr(f"vec_id div {BATCH}").alias("batch"), vectors.focal_loss(F.col("logits"), F.col("truth"), 0.0).alias("ce"))
    return rows.groupBy("batch").agg(F.avg("ce").alias("l")).agg(F.round(F.avg("l"), 6).alias("mean_loss"))


def loss_trailing_mean(spark, d):
    """Mean of the last 50 values at every 50th event, events as training steps."""
    return evaluate.trailing_mean(table(spark, d, "events", "event_id", "value"), "event_id", "value").select(F.col("event_id").alias("step"), F.round("mean", 6).alias("mean"))


def early_stopping(spark, d):
    """Best score and stop of each user's series of values."""
    rows = table(spark, d, "events", "user_id", "event_id", "value")
    return evaluate.early_stopping(rows, "user_id", "event_id", "value")


def predict_labels(spark, d):
    """Predictions of the bundled scorer, fitted on the training split, for the evaluation splits."""
    rows = table(spark, d, "dataset_ml_ready", "sample_id", "code", "cwe_id", "split").withColumn("label_id", label_id(F.col("cwe_id")))
    model = scorer.fit_scorer(rows.where("split = 'train'").select("code", "label_id"))
    out = scorer.predicted(rows.where("split <> 'train'").select("sample_id", "code", "label_id"), scorer.model_scorer(model))
    return out.select("sample_id", F.element_at(F.array(*[F.lit(x) for x in LABEL_NAMES]), F.col("label_id") + 1).alias("truth"), "prediction.label", "prediction.confidence")


QUERIES = {
    f.__name__: f
    for f in (
        reduce_sample, stratified_split, class_weights, sampler_weights, weighted_resample, chunk_assign, batching, sliding_windows, sliding_windows_infer,
        sampled_windows, sampled_windows_raw, build_window, ragged_offsets, cache_roundtrip, rename_candidates, rename_map, pool_max, pool_mean, pool_attention,
        softmax_predict, predict_top3, focal_loss, lr_schedule, eval_overall, eval_report, eval_loss, loss_trailing_mean, early_stopping, predict_labels,
    )
} | {"augment": augmented}

#: Training forms that run over the training corpus too, as ``corpus_...`` with its ``sample_id``.
ON_CORPUS = {
    "sliding_windows": sliding_windows, "sampled_windows": sampled_windows, "sampled_windows_raw": sampled_windows_raw, "build_window": build_window,
    "ragged_offsets": ragged_offsets, "cache_roundtrip": cache_roundtrip, "rename_candidates": rename_candidates, "rename_map": rename_map, "augment": augmented,
    "code_tokens": code_token_counts, "preserved_tokens": preserved_tokens,
}


def _on_corpus(query):
    return lambda spark, d: query(spark, d, corpus).withColumnRenamed("payload_id", "sample_id")


QUERIES |= {f"corpus_{name}": _on_corpus(query) for name, query in ON_CORPUS.items()}

_LABELLED = f"labelled as (select sample_id, ({S.LABEL_ID})::bigint as label_id from dataset_ml_ready)"
_RANK = "row_number() over (partition by label_id order by md5('42:' || sample_id), sample_id)"
_PLACE = "select sample_id, row_number() over (order by md5('42:' || sample_id), sample_id) - 1 as place, count(*) over () as n from dataset_ml_ready"


def _number(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def _windows_sql(tokens: str, policy: str) -> str:
    sampled = "when n > 4080 then [(i * (n - 510)) // 7 for i in range(0, 8)]" if policy == "training" else ""
    return f"""with {S.BLOCKS}, t as (select payload_id, {tokens} as t from blocks), c as (select payload_id, t, len(t) as n from t),
s as (select payload_id, t, n, case {sampled} when n <= 510 then [0] else [256 * i for i in range(0, least(8, (n - 127) // 256 + 1))] end as starts from c),
w as (select payload_id, t, n, starts, unnest(range(0, len(starts))) as window_no from s),
p as (select payload_id, window_no, starts[window_no + 1] as start, t, n from w)
select payload_id, window_no::int as window_no, start::bigint as start, least(510, n - start)::bigint as n_tokens, md5(array_to_string(t[start + 1:start + 510], ' ')) as digest from p"""


_CANDIDATES = f"""cand as (
  select payload_id, token, count(*) as n_uses, min(place) as first_at from (
    select payload_id, t[i] as token, i as place from (select payload_id, t, unnest(range(1, len(t) + 1)) as i from (select payload_id, {_TOKENS} as t from blocks)))
  where length(token) >= 3 and regexp_matches(replace(token, '_', ''), '^[\\p{{L}}\\p{{N}}]+$') and not list_contains({S.PRESERVED}, lower(token)) group by 1, 2),
top as (select payload_id, token, n_uses, place from (
  select *, row_number() over (partition by payload_id order by n_uses desc, first_at) - 1 as place from cand) where place < 10),
names as (select payload_id, token, 'var_' || place as new_name from top where {_number("'rename:' || payload_id || ':' || place")} / 4294967296.0::double < 0.5)"""
_LOGITS = "logits as (select vec_id, [x::double for x in embedding[1:8]] as l, (label % 8)::bigint as truth from embeddings)"
_SOFT = f"{_LOGITS}, soft as (select vec_id, l, truth, [exp(x - list_max(l)) / list_sum([exp(y - list_max(l)) for y in l]) for x in l] as p from logits)"
_CE = "(ln(list_sum([exp(x - list_max(l)) for x in l])) + list_max(l) - l[truth + 1])"
_GUESS = f"{_LOGITS}, guess as (select truth, list_position(l, list_max(l)) - 1 as guess from logits)"
_RATED = f"""{_GUESS}, labels as (select truth as label from guess union select guess from guess),
rated as (select label, count(*) filter (where truth = label and guess = label) as hit, count(*) filter (where guess = label) as guessed,
  count(*) filter (where truth = label) as support from labels, guess group by 1),
rates as (select label, case when guessed > 0 then hit / guessed::double else 0.0 end as precision, case when support > 0 then hit / support::double else 0.0 end as recall,
  case when guessed + support > 0 then 2 * hit::double / (guessed + support) else 0.0 end as f1, support from rated)"""
_DIMS = "dims as (select label, i - 1 as dim, embedding[i]::double as x, vec_id from (select *, unnest(range(1, 65)) as i from embeddings))"
_WEIGHTS = "[" + ", ".join(f"{w}::double" for w in CLASS_WEIGHTS) + "]"


def _attention() -> str:
    parts = []
    for h, b, o in zip(HIDDEN, BIAS, OUT):
        total = " + ".join(f"embedding[{i + 1}]::double * {w!r}::double" for i, w in enumerate(h))
        parts.append(f"{o}::double * tanh({total} + {b}::double)")
    return " + ".join(parts)


ORACLE = {
    "reduce_sample": f"""with r as (select *, row_number() over (partition by sample_id // 10000 order by md5('42:' || sample_id), sample_id) as rn,
  count(*) over (partition by sample_id // 10000) as n from dataset_ml_ready)
select sample_id, programming_language, nloc, cwe_id, ({_PARAMETERS})::bigint as parameters_count from r where rn <= round_even(0.3::double * n, 0)""",
    "stratified_split": f"""with {_LABELLED} select sample_id, label_id,
  case when {_RANK} <= ceil(0.1::double * count(*) over (partition by label_id)) then 'val' else 'train' end as part from labelled""",
    "class_weights": f"""with {_LABELLED}, c as (select l.i as label_id, count(x.label_id) as n_rows from range(0, 8) l(i) left join labelled x on x.label_id = l.i group by 1),
w as (select label_id, n_rows, (select count(*) from labelled) / (8 * greatest(n_rows, 1))::double as w from c)
select label_id, n_rows, round(w / (select avg(w) from w), 9) as weight from w""",
    "sampler_weights": f"with {_LABELLED} select sample_id, round(1.0::double / count(*) over (partition by label_id), 9) as weight from labelled",
    "weighted_resample": f"""with {_LABELLED}, ranked as (select *, {_RANK} as rn from labelled),
held as (select label_id, count(*) as n, row_number() over (order by label_id::varchar) - 1 as i from labelled group by 1),
draws as (select i as draw_no, {_number("'label:' || i")} % (select count(*) from held) as li, {_number("'row:' || i")} as d from range(0, (select count(*) from labelled)) t(i))
select draw_no, ranked.label_id, sample_id from draws join held on held.i = li join ranked on ranked.label_id = held.label_id and rn = d % n + 1""",
    "chunk_assign": f"with p as ({_PLACE}) select sample_id, ntile({CHUNKS}) over (order by place) - 1 as chunk from p",
    "batching": f"with p as ({_PLACE}) select sample_id, place // {BATCH} as batch, place % {BATCH} as slot from p",
    "sliding_windows": _windows_sql(_TOKENS, "training"),
    "sliding_windows_infer": _windows_sql(_TOKENS, "inference"),
    "sampled_windows": _windows_sql(_TOKENS.replace("(code", f"(repeat(code, {REPEATS})"), "training"),
    "sampled_windows_raw": f"""with {S.BLOCKS}, r as (select payload_id, repeat(code, {RAW_REPEATS}) as code from blocks), b as (select payload_id, code, length(code) as n from r where length(code) > 50000),
w as (select payload_id, code, n, unnest(range(0, 8)) as i from b)
select payload_id, i::int as window_no, (i * (n - 3000)) // 7 as start, md5(substr(code, (i * (n - 3000)) // 7 + 1, 3000)) as digest from w""",
    "build_window": f"""with {S.BLOCKS}, t as (select payload_id, {_TOKENS}[1:510] as t from blocks), i as (
  select payload_id, len(t) as n, [0] || [('0x' || substr(md5(x), 1, 6))::bigint % 50000 + 4 for x in t] || [2] as ids from t)
select payload_id, md5(array_to_string(ids || [1 for x in range(0, 510 - n)], ',')) as digest, n + 2 as n_real from i""",
    "ragged_offsets": f"""with {S.BLOCKS}, t as (select payload_id, len({_TOKENS}) as n from blocks),
p as (select payload_id, case when n <= 510 then 1 else least(8, (n - 127) // 256 + 1) end as n_windows,
  (row_number() over (order by md5('42:' || payload_id), payload_id) - 1) // {BATCH} as batch from t)
select payload_id, batch, n_windows, coalesce(sum(n_windows) over (partition by batch order by payload_id rows between unbounded preceding and 1 preceding), 0)::bigint as offset from p""",
    "cache_roundtrip": f"select payload_id, window_no, n_tokens from ({_windows_sql(_TOKENS, 'training')})",
    "rename_candidates": f"with {S.BLOCKS}, {_CANDIDATES} select * from top",
    "rename_map": f"with {S.BLOCKS}, {_CANDIDATES} select * from names",
    "augment": f"""with {S.BLOCKS}, {_CANDIDATES}, picked as (
  select payload_id, code, {_TOKENS} as t, {_number("'augment:' || payload_id")} / 4294967296.0::double < 0.3 as changed,
    {_number("'renaming:' || payload_id")} / 4294967296.0::double < 0.3 as renamed from blocks),
words as (select payload_id, renamed, i, t[i] as t from (select payload_id, renamed, t, unnest(range(1, len(t) + 1)) as i from picked where changed)),
new as (select w.payload_id, string_agg(case when list_contains({S.PRESERVED}, lower(w.t)) or (length(w.t) = 1 and not regexp_matches(w.t, '[\\p{{L}}\\p{{N}}]')) then w.t
  when w.renamed and n.new_name is not null then n.new_name when {_number("'mask:' || w.payload_id || ':' || (w.i - 1)")} / 4294967296.0::double < 0.1 then '<mask>' else w.t end, ' ' order by w.i) as code
  from words w left join names n on n.payload_id = w.payload_id and n.token = w.t group by 1)
select p.payload_id, changed, md5(case when changed then coalesce(new.code, '') else p.code end) as digest from picked p left join new using (payload_id)""",
    "pool_max": f"with {_DIMS} select label, dim, round(max(x), 6) as value from dims group by 1, 2",
    "pool_mean": f"with {_DIMS} select label, dim, round(avg(x), 6) as value from dims group by 1, 2",
    "pool_attention": f"""with {_DIMS}, s as (select vec_id, label, {_attention()} as s from embeddings),
w as (select vec_id, exp(s - max(s) over (partition by label)) as w from s)
select label, dim, round(sum(w * x) / sum(w), 6) as value from dims join w using (vec_id) group by 1, 2""",
    "softmax_predict": f"""with {_SOFT} select vec_id, ({S.text_list(LABEL_NAMES)})[list_position(p, list_max(p))] as label, round(list_max(p), 6) as confidence, round(p[8], 6) as p_other from soft""",
    "predict_top3": f"""with {_SOFT}, e as (select vec_id, i, p[i] as q from (select vec_id, p, unnest(range(1, 9)) as i from soft)),
r as (select *, row_number() over (partition by vec_id order by q desc, i) - 1 as place from e)
select vec_id, place, ({S.text_list(LABEL_NAMES)})[i] as label, round(q, 6) as probability, repeat('█', floor(q * 20)::int) as bar from r where place < 3""",
    "focal_loss": f"""with {_LOGITS}, c as (select {_CE} as ce, {_CE} * {_WEIGHTS}[truth + 1] as wce from logits)
select round(avg(pow(1 - exp(-ce), 2) * ce), 6) as loss, round(avg(pow(1 - exp(-wce), 2) * wce), 6) as weighted_loss from c""",
    "lr_schedule": f"""select i as step, round(1e6::double * {PEAK!r}::double * case when i < 100 then i / 100.0::double
  else greatest(0.0, 0.5::double * (1 + cos(3.141592653589793::double * ((i - 100) / 900.0::double)))) end, 6) as rate from range(0, {STEPS}) t(i)""",
    "eval_overall": f"with {_RATED} select round(avg((truth = guess)::int), 6) as accuracy, (select round(avg(f1), 6) from rates) as macro_f1 from guess",
    "eval_report": f"""with {_RATED}, a as (select label::varchar as label, precision, recall, f1, support from rates
  union all select 'macro', avg(precision), avg(recall), avg(f1), sum(support)::bigint from rates
  union all select 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::bigint from rates)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from a""",
    "eval_loss": f"with {_LOGITS}, b as (select vec_id // {BATCH} as b, avg({_CE}) as l from logits group by 1) select round(avg(l), 6) as mean_loss from b",
    "loss_trailing_mean": """with m as (select event_id as step, avg(value) over (order by event_id rows between 49 preceding and current row) as m from events)
select step, round(m, 6) as mean from m where (step + 1) % 50 = 0""",
    "early_stopping": """with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as k from events where value is not null),
f as (
  select user_id, k, value as best, event_id as best_at, 0 as bad, null::bigint as stop from e where k = 1
  union all
  select f.user_id, e.k, case when f.stop is null and e.value > f.best + 0.0001::double then e.value else f.best end,
    case when f.stop is null and e.value > f.best + 0.0001::double then e.event_id else f.best_at end,
    case when f.stop is null and e.value > f.best + 0.0001::double then 0 else f.bad + 1 end,
    case when f.stop is not null then f.stop when e.value > f.best + 0.0001::double then null when f.bad + 1 >= 3 then e.event_id end
  from f join e on e.user_id = f.user_id and e.k = f.k + 1)
select user_id, best, best_at as best_epoch, stop as stopped_at from f where k = (select max(k) from e where e.user_id = f.user_id)""",
}


def _corpus_sql(name: str) -> str:
    """The SQL of a query on the audit requests, its blocks taken from the corpus."""
    sql = (AUDIT_SQL | ORACLE)[name].replace(S.BLOCKS, "blocks as (select sample_id as payload_id, code from dataset_ml_ready where code is not null)")
    return sql if name == "preserved_tokens" else f"select payload_id as sample_id, * exclude (payload_id) from ({sql})"


ORACLE |= {f"corpus_{name}": _corpus_sql(name) for name in ON_CORPUS}
