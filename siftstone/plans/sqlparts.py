"""Fragments of the oracle SQL shared by the plan modules."""

from __future__ import annotations

from siftstone.functions.dictionaries import EXTENSIONS, LANGUAGE_NAMES, METRIC_LANGUAGES, RESERVED_WORDS, STATIC_RULES, TOP_CWES, indicators

WS = r"\t-\r\x{1C}-\x{20}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_list(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{WORD}]+')"


def case_of(x: str, entries: dict, default: str) -> str:
    return f"case {x} " + " ".join(f"when {quoted(k)} then {v if isinstance(v, int) else quoted(v)}" for k, v in entries.items()) + f" else {default} end"


LANG_KEY = strip("lower(coalesce(programming_language, 'None'))")
RULE_LANG = "case when {0} in ('js', 'ts', 'typescript') then 'javascript' when {0} in ('c++', 'cpp') then 'c' else {0} end"
LABEL_ID = case_of("cwe_id", {"Safe": 0} | {c: i + 1 for i, c in enumerate(TOP_CWES)}, "7")
METRIC_LANG = case_of("lang", METRIC_LANGUAGES, "null")
EXTENSION = case_of("lang", EXTENSIONS, "'.txt'")
LANG_ID = case_of("programming_language", {n: i for i, n in enumerate(LANGUAGE_NAMES)}, str(len(LANGUAGE_NAMES)))
INDICATORS = text_list(indicators())
PRESERVED = text_list(sorted({*indicators(), *RESERVED_WORDS}))
RULES = "rules(lang, pattern, message, severity) as (values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in STATIC_RULES) + ")"
BLOCKS = f"blocks as (select payload_id, pr_id, filename, code, {LANG_KEY} as lang from code_payload where code is not null)"
LINES = f"""lines as (
  select payload_id, lang, i as line_no, ls[i] as line from (
    select payload_id, {RULE_LANG.format('lang')} as lang, ls, unnest(range(1, len(ls) + 1)) as i
    from (select payload_id, lang, string_split(code, chr(10)) as ls from blocks)))"""
FINDINGS = f"""findings as (
  select payload_id, line_no, substr({strip('line')}, 1, 80) as content, message, severity
  from lines join rules using (lang) where regexp_matches(line, pattern))"""
SCORES = f"""scores as (
  select b.*, list_sort(list_filter(list_distinct({words('code')}), lambda t: list_contains({INDICATORS}, t))) as tags, coalesce(f.n, 0) as n_findings
  from blocks b left join (select payload_id, count(*) as n from findings group by 1) f using (payload_id)),
risks as (
  select *, len(tags) as n_tags, least(len(tags) * 0.15::double + n_findings * 0.4::double, 1.0::double) as risk_score from scores)"""
AUDIT = f"with {RULES}, {BLOCKS}, {LINES}, {FINDINGS}, {SCORES}"
SPLIT_LINES = r"regexp_split_to_array({0}, '\r\n|[\n\r\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]')"

# The form of a code: letters and digits only, the entries of innermost braces sorted where all begin with a key.
_BLANK = r"[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]"
_KEY = rf"""^{_BLANK}*\.?{_BLANK}*["''`]?{_BLANK}*[\p{{L}}\p{{N}}_]+{_BLANK}*["''`]?{_BLANK}*[:=]"""
_LETTERS = r"regexp_replace(%s, '[^\p{L}\p{N}]+', '', 'g')"
_ENTRIES = rf"list_filter(string_split(s[2:-2], ','), lambda e: regexp_matches(e, '[^\t-\r\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}]'))"
FORM = rf"""array_to_string(list_transform(regexp_extract_all(lower(code), '\{{[^{{}}]*\}}|[^{{}}]+|[{{}}]'), lambda s:
  case when len(s) > 1 and s[1] = '{{' and len(list_filter({_ENTRIES}, lambda e: not regexp_matches(e, '{_KEY}'))) = 0
  then array_to_string(list_sort(list_transform({_ENTRIES}, lambda e: {_LETTERS % 'e'})), '') else {_LETTERS % 's'} end), '')"""
