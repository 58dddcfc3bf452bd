"""The SQL of the training-data queries."""

from __future__ import annotations

from siftstone.plans.skewed_keys import LABEL_SQL, READ_SQL
from siftstone.plans.sqlparts import FORM

_NEED = "greatest((target_bp * (select count(*) // 5 from dataset_ml_ready) + 9999) // 10000, min_rows)"
_WORDS = r"regexp_extract_all(lower(code), '[\p{L}\p{N}_]+')"
_SHINGLES = f"""words as (select sample_id, {_WORDS} as w from dataset_ml_ready where code is not null),
runs as (
  select distinct sample_id, case when len(w) < 3 then array_to_string(w, ' ')
    else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end as run
  from (select sample_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from words where len(w) > 0)),
sizes as (select sample_id, count(*) as n from runs group by 1),
alike as (
  select a.sample_id as sample_a, b.sample_id as sample_b
  from runs a join runs b on a.run = b.run and a.sample_id < b.sample_id
  join sizes sa on sa.sample_id = a.sample_id join sizes sb on sb.sample_id = b.sample_id
  group by 1, 2, sa.n, sb.n having count(*) * 17 >= (sa.n + sb.n) * 7)"""

_TOKENS = r"regexp_extract_all(code, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r \x{85}\p{Z}]')"

_FORMS = f"forms as (select sample_id, split, form from (select sample_id, split, {FORM} as form from dataset_ml_ready where code is not null) where form <> '')"

_STRATA = f"""{READ_SQL}, strata as (
  select case when label in ('Safe', 'CWE-79', 'CWE-89', 'CWE-78', 'CWE-22', 'CWE-434', 'CWE-352') then label else 'Other' end as cwe_label,
    language as programming_language from read)"""
_OVERLAPS = f"""{_SHINGLES}, {_FORMS}, splits as (select sample_id, split from dataset_ml_ready),
common as (
  select case when a.split = 'train' then sample_a else sample_b end as train_id, case when a.split = 'train' then sample_b else sample_a end as eval_id
  from alike join splits a on a.sample_id = sample_a join splits b on b.sample_id = sample_b
  where (a.split = 'train' and b.split in ('val', 'test')) or (b.split = 'train' and a.split in ('val', 'test'))
  union
  select t.sample_id, e.sample_id from forms t join forms e using (form) where t.split = 'train' and e.split in ('val', 'test'))"""

ORACLE = {
    "p1_found": f"""with {_STRATA}
select t.cwe_label, t.programming_language from sampling_target t
where (select count(*) from strata s where s.cwe_label = t.cwe_label and s.programming_language = t.programming_language) < {_NEED}""",
    "p4_found": f"""select 'dataset_ml_ready' as table_name, sample_id as item_id from dataset_ml_ready where len({_TOKENS}) > 510
union all select 'code_payload', payload_id from code_payload where len({_TOKENS}) > 510""",
    "p3_found": f"with {_SHINGLES} select sample_a, sample_b from alike",
    "p2_found": f"""with {_FORMS} select * from (select min(sample_id) over (partition by form) as kept_id, sample_id from forms)
where kept_id <> sample_id""",
    "p6_found": f"with {_OVERLAPS} select least(train_id, eval_id) as sample_a, greatest(train_id, eval_id) as sample_b from common",
    "p6_report": f"""with {_OVERLAPS}, partners as (select eval_id, count(*) as n from common group by 1),
same as (select distinct e.sample_id as eval_id from forms t join forms e using (form) where t.split = 'train' and e.split in ('val', 'test'))
select split, source, {LABEL_SQL} as cwe_label, count(*) as n_rows, count(p.n) as n_overlapping, count(s.eval_id) as n_same_form, coalesce(sum(p.n), 0)::bigint as n_pairs
from dataset_ml_ready d left join partners p on p.eval_id = sample_id left join same s on s.eval_id = sample_id where split in ('val', 'test') group by 1, 2, 3""",
    "p1_report": f"""with {_STRATA}, held as (select cwe_label, programming_language, count(*) as n from strata group by 1, 2),
needs as (select *, {_NEED} as required from sampling_target)
select cwe_label, programming_language, target_bp::bigint as target_bp, min_rows::bigint as min_rows, required::bigint as required, coalesce(n, 0) as available,
  greatest(0, required - coalesce(n, 0))::bigint as missing from needs left join held using (cwe_label, programming_language)""",
    "p1_checked": f"""with {_STRATA}, held as (select cwe_label, programming_language, count(*) as n from strata group by 1, 2)
select cwe_label, programming_language, coalesce(n, 0) as available, true as keeps_minimum, (select count(*) // 5 from dataset_ml_ready) as sample_rows
from sampling_target left join held using (cwe_label, programming_language)""",
    "p4_checked": f"""select 'dataset_ml_ready' as table_name, sample_id as item_id, len({_TOKENS}) as n_tokens, true as "right" from dataset_ml_ready where len({_TOKENS}) > 510
union all select 'code_payload', payload_id, len({_TOKENS}), true from code_payload where len({_TOKENS}) > 510""",
    "p7_checked": """select doc_id, true as "right" from documents where text <> ''""",
    "p8_checked": r"""select regexp_replace(lower(trim(source)), '[^\p{L}\p{N}]+', '_', 'g') as source, target_share, max_repeats, true as share_met, true as repeats_kept
from source_weight""",
    "p2_records": f"""with {_FORMS} select min(sample_id) as kept_id, count(*) as n_copies from forms group by form
union all select sample_id, 1 from dataset_ml_ready where sample_id not in (select sample_id from forms)""",
    "p3_groups": f"""with recursive {_SHINGLES}, keyed as (select sample_id, array_to_string(list_sort(list(run)), chr(10)) as key from runs group by 1),
members as (select sample_id, min(sample_id) over (partition by key) as class_id from keyed),
links as (
  select distinct a.class_id as u, b.class_id as v from alike join members a on a.sample_id = sample_a join members b on b.sample_id = sample_b where a.class_id <> b.class_id),
both_ways as (select u, v from links union select v, u from links),
reach as (select u as node, u as root from both_ways union select v, root from reach join both_ways on u = node),
roots as (select node, min(root) as root from reach group by 1), degree as (select u, count(*) as n from both_ways group by 1)
select sample_id, coalesce(class_id, sample_id) as class_id, coalesce(root, class_id, sample_id) as group_id, coalesce(n, 0) as n_links
from dataset_ml_ready left join members using (sample_id) left join roots on node = class_id left join degree on u = class_id""",
}
