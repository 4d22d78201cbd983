"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanewise.llm import hardneg, phrases
from lanewise.llm.ann import op1_ann
from lanewise.llm.bpe import op13_bpe
from lanewise.llm.chat import op2_chat
from lanewise.llm.decontam import op7_decontaminate
from lanewise.llm.hardneg import op11_hardneg
from lanewise.llm.htmltext import op9_htmltext
from lanewise.llm.langid import op8_langid
from lanewise.llm.licenses import op6_licenses
from lanewise.llm.neardup import op4_neardup
from lanewise.llm.packing import op5_packing
from lanewise.llm.phrases import op12_phrases
from lanewise.llm.pii import op10_pii
from lanewise.llm.secrets import op3_secrets

OPERATORS = (op1_ann, op2_chat, op3_secrets, op4_neardup, op5_packing, op6_licenses, op7_decontaminate, op8_langid, op9_htmltext, op10_pii, op11_hardneg, op12_phrases, op13_bpe)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{f.__name__: f for f in OPERATORS}, "pipeline": pipeline}


_CHAT = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### : </turn>') + 1
    + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:'))
    + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))) as bigint) as formatted_chars,
  false as rewrites
from turns group by conv_id
"""

_NEARDUP = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) = 1 then [ws[1]]
    else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as g from w),
f as (select g, count(*) as df from s group by g),
n as (select doc_id, count(*) as n from s group by doc_id),
r as (select s.doc_id, s.g, n.n, row_number() over (partition by s.doc_id order by f.df, s.g) as place from s join f using (g) join n using (doc_id)),
p as (select doc_id, g, n from r where place <= n - (8 * n + 9) // 10 + 1),
c as (select distinct a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny from p a join p b on a.g = b.g and a.doc_id < b.doc_id
  where 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
i as (select x, y, any_value(nx) as nx, any_value(ny) as ny, count(*) as common from c join s a on a.doc_id = x join s b on b.doc_id = y and a.g = b.g group by x, y),
l as (select x, y from i where 100 * common >= 80 * (nx + ny - common)),
e as (select x, y from l union all select y, x from l),
t(a, b) as (select x, y from e union select t.a, e.y from t join e on e.x = t.b),
m as (select a, min(b) as b from t group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) as kept
from documents d left join n using (doc_id) left join m on m.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": _CHAT, "op4_neardup": _NEARDUP, "op11_hardneg": hardneg.ORACLE_SQL, "op12_phrases": phrases.ORACLE_SQL}
