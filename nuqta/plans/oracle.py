"""SQL for DuckDB that builds the derived corpus and answers the registered queries."""

from __future__ import annotations

from .derived import ARABIC, FATHA, LATIN, to_arabic

WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LETTERS = r"\x{0621}-\x{064A}"
MARKS = r"\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E8}\x{06EA}-\x{06FC}"
FOLD_FROM, FOLD_TO = "إأآٱؤئى", "ااااءءي"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def tashkeel(x: str) -> str:
    return sub(f"translate({x}, 'ٱ', 'ا')", f"[{MARKS}]")


def norm(x: str) -> str:
    y = sub(tashkeel(f"coalesce({x}, '')"), r"[\x{0670}\x{0640}]")
    y = sub(f"translate({y}, '{FOLD_FROM}', '{FOLD_TO}')", r"[\r\n]+", " ")
    return sub(sub(sub(y, f"[^{LETTERS}{WS}-]+"), f"[{WS}]{{2,}}", " "), f"^[{WS}]+|[{WS}]+$")


def strip(x: str) -> str:
    return sub(x, f"[^{LETTERS}]")


def split(x: str) -> str:
    return f"regexp_split_to_array({x}, '[{WS}]+')"


def lemma(x: str) -> str:
    return f"substr({x}, 1, 4)"


def root(x: str) -> str:
    return f"array_to_string(list_filter(string_split(substr(translate({x}, 'اوي', ''), 1, 3), ''), lambda c: c <> ''), ' ')"


BASE = f"""
pieces as (select doc_id, regexp_split_to_array(text, '[.\\n]+') as a from documents where doc_id is not null and text is not null),
rows_ as (select doc_id, unnest(a) as v, generate_subscripts(a, 1) - 1 as pos from pieces),
verses as materialized (select gid, standard, regexp_replace(standard, '([بتد])', '\\1{FATHA}', 'g') as uthmani from (
  select cast(doc_id as bigint) * 4294967296 + pos as gid, translate(lower(v), '{LATIN}', '{ARABIC}') as standard from rows_)),
normal as materialized (select gid, standard, uthmani, {norm('standard')} as norm from verses),
words as materialized (select gid, w, n from (select gid, unnest(a) as w, generate_subscripts(a, 1) as n from (select gid, string_split(norm, ' ') as a from normal)) where w <> ''),
vocab as materialized (select distinct w from words),
dict as materialized (select w as token, {lemma('w')} as lemma, nullif({root('w')}, '') as root from vocab where length(w) >= 4),
morph as materialized (select gid, w, n, {lemma('w')} as lemma, nullif({root('w')}, '') as root from words),
raw as materialized (select gid, n, raw, {strip('raw')} as stripped, {norm(strip('raw'))} as norm from (
  select gid, unnest(a) as raw, generate_subscripts(a, 1) as n from (select gid, {split('standard')} as a from verses)))"""


def batch(queries: list[tuple[int, str]]) -> str:
    """CTEs q (qid, tpos, token, need) of queries that aren't empty when cleaned."""
    values = ", ".join(f"({i}, '{to_arabic(t)}')" for i, t in queries)
    clean = norm(sub("query", f"[^{LETTERS}{WS}]"))
    return f"""
asked as (select qid, {clean} as clean from (values {values}) as t(qid, query)),
q as materialized (select qid, unnest(a) as token, generate_subscripts(a, 1) - 1 as tpos, len(a) as need from (select qid, {split('clean')} as a from asked where clean <> '')),
tok as materialized (select distinct token from q)"""


SIMPLE = """
has as materialized (select distinct token, gid from tok join vocab on contains(w, token) join words using (w)),
simple as materialized (select qid, gid from q join has using (token) group by qid, gid, need having count(distinct tpos) = need)"""

LINGUISTIC = """
entry as materialized (select token, lemma, root from tok join dict using (token)),
lem as materialized (select distinct token, gid from entry e join (select distinct lemma as l from morph) on contains(l, e.lemma) join morph m on m.lemma = l),
roo as materialized (select distinct token, gid from entry e join (select distinct root as r from morph where root is not null) on contains(r, e.root) join morph m on m.root = r),
ling as materialized (select token, gid, min(rank) as rank from (select token, gid, 0 as rank from lem union all select token, gid, 1 from roo) group by all),
advanced as materialized (select qid, gid, min(case when tpos = 0 then rank end) as rank from q join ling using (token) group by qid, gid, need having count(distinct tpos) = need)"""

SCORED = """
found as materialized (select qid, gid, case when s.gid is not null then 0 else 1 end as layer, case when s.gid is not null then 0 else a.rank end as rank
  from simple s full join advanced a using (qid, gid)),
hits as materialized (
  select qid, f.gid, tpos, 0 as kind, stripped as s, min(n) as n from found f join q using (qid) join raw r on r.gid = f.gid and contains(r.norm, token) group by all
  union all select qid, f.gid, tpos, 1, m.lemma, min(n) from found f join q using (qid) join entry e using (token) join morph m on m.gid = f.gid and contains(m.lemma, e.lemma) group by all
  union all select * from rooted),
score as materialized (select qid, gid, cast(sum(case kind when 0 then 3 when 1 then 2 else 1 end) as double) as score,
   min(tpos) as lead, min_by(kind, tpos * 10 + kind) as lead_kind, bool_or(kind = 1) as any_lemma from hits group by all),
scored as materialized (select f.qid, f.gid, f.layer, f.rank, coalesce(score, 0.0) as score,
   case when lead is null then 'none' when lead_kind = 0 then 'exact' when any_lemma then 'lemma' else 'root' end as type from found f left join score s on s.qid = f.qid and s.gid = f.gid)"""

#: Root hits: words the dictionary relates to the root, or where a verse has none, its roots.
ROOTED = """
by_word as materialized (select qid, f.gid, tpos, 2 as kind, r.raw as s, min(n) as n from (select qid, gid from found_) f join q using (qid) join entry e using (token)
  join raw r on r.gid = f.gid join dict d on d.token = r.norm and contains(d.root, e.root) group by all),
rooted as materialized (select * from by_word union all
  select qid, f.gid, tpos, 2, m.root, min(n) from (select qid, gid from found_) f join q using (qid) join entry e using (token) join morph m on m.gid = f.gid and contains(m.root, e.root)
  where not exists (select 1 from by_word b where b.qid = f.qid and b.gid = f.gid and b.tpos = q.tpos) group by all)"""
FOUND_ = "found_ as materialized (select qid, gid from simple union select qid, gid from advanced)"


def search_ctes(queries: list[tuple[int, str]]) -> str:
    return "with " + ",".join([BASE, batch(queries), SIMPLE, LINGUISTIC, FOUND_, ROOTED, SCORED])


#: The tokens that the dictionary doesn't relate to a verse, by near words of both fields.
FUZZY = f"""
able as (select qid from q group by qid having bool_and(length(token) >= 3 or token in (select token from ling))),
rest as (select distinct token from q where qid in (select qid from able) and token not in (select token from ling)),
fields as materialized (select gid, raw as word from raw where raw <> '' union all select gid, regexp_replace(raw, '([بتد])', '\\1{FATHA}', 'g') from raw where raw <> ''),
near as materialized (select token, word, list_min(flatten(list_transform(range(0, length(b) + 1), lambda i: list_transform(range(0, least(length(b) - i, 2 * length(a)) + 1), lambda k: levenshtein(a, substr(b, i + 1, k))))))
  / cast(length(token) as double) as score from (select token, word, %TOKEN as a, %WORD as b from rest, (select distinct word from fields) where length(word) >= length(token) * 0.5)),
cuts as (select token, case when min(score) <= 0.25 then 0.35 else 0.5 end as cut from near where score <= 0.5 group by token),
fuzz as materialized (select token, gid, min(score) as best, min_by(n, score) as n, any_value(cut) as cut
  from (select token, gid, score, count(*) as n from near join fields using (word) where score <= 0.5 group by all) join cuts using (token) group by token, gid having min(score) <= any_value(cut)),
advanced as materialized (select qid, gid, min(case when tpos = 0 then rank end) as rank, sum(n) as ranges
  from q join (select token, gid, rank, 0 as n from ling union all select token, gid, 2, n from fuzz) using (token) group by qid, gid, need having count(distinct tpos) = need)"""


def fuzzy_ctes(queries: list[tuple[int, str]]) -> str:
    """As ``search_ctes``, with the fuzzy layer; advanced has the number of fuzzy ranges."""
    folded = "".join(dict.fromkeys(ARABIC.translate(str.maketrans(FOLD_FROM, FOLD_TO))))
    of = lambda x: f"translate({x}, '{folded}', '{LATIN[: len(folded)]}')"
    fuzzy = FUZZY.replace("%TOKEN", of("token")).replace("%WORD", sub(of("word"), r"[^\x{00}-\x{7F}]", "~"))
    exact = LINGUISTIC[: LINGUISTIC.index(",\nadvanced as")]
    return "with " + ",".join([BASE, batch(queries), SIMPLE, exact, fuzzy, FOUND_, ROOTED, SCORED])
