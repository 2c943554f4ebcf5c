"""Queries of texts: similarity, rules as an index of words."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import fixed, taxonomy
from .operators import analytics as A
from .operators import similarity as M
from .registry import TXN, query, txn
from .sources import tables as S


def quoted(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A table of constants for DuckDB."""
    said = ", ".join("(" + ", ".join(str(x) if isinstance(x, (int, float)) else quoted(x) for x in r) + ")" for r in rows)
    return f"(select * from (values {said}) v({names}))"


#: The rules as DuckDB's patterns, whose own word bounds know ASCII only.
RULES = values([(i, c, sub, r"(^|[^\pL\pN_])(" + "|".join(ws).replace("ı", "i") + r")([^\pL\pN_]|$)") for i, (c, _, sub, ws) in enumerate(fixed.TAXONOMY) if ws], "ord, category, subcategory, pattern")
FOLD = "lower(translate({}, 'İıſ\u212a', 'iisk'))"
NOISE = "|".join(fixed.MERCHANT_NOISE)
#: (description, raw, said): each text as it is, twice (as merchant and description), and without noise.
SAID = rf"""{TXN}, rows_ as (select input_id, seq, direction, [{", ".join(map(quoted, S.MERCHANT_TEXTS))}][seq % {len(S.MERCHANT_TEXTS)} + 1] as description from txn), texts as (select description, description || ' ' || description as raw from (select distinct description from rows_)),
 said as (select *, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '\b({NOISE})\b', ' ', 'g'), '\d{{2,}}', ' ', 'g'), '[*/_|#:;.,()\[\]]+', ' ', 'g'), '\s+', ' ', 'g')), ''), trim(lower(raw))) as said from texts)"""
RULED = f"ruled as (select description, said, (select min(ord) from {RULES} r where regexp_matches({FOLD.format("raw || ' ' || said")}, r.pattern)) as ord from said)"
PIECES = "select k, piece, count(*) as n from (select k, unnest(list_transform(range(1, length(w) + 1), lambda i: substr('_' || w || '_', i, 3))) as piece from (select k, unnest(regexp_extract_all({fold}, '[\\p{{L}}\\p{{N}}]+')) as w from ({of}))) group by all"
EXAMPLES = values([(i, c, sub, x) for i, (c, _, sub, _) in enumerate(fixed.TAXONOMY) if c != "other" for x in fixed.EXAMPLES[sub]], "ord, category, subcategory, example")
N_EXAMPLES = sum(len(fixed.EXAMPLES[sub]) for c, _, sub, _ in fixed.TAXONOMY if c != "other")


def cosine(of: str) -> str:
    """Common table expressions: near (k, example, ord, similarity) of all texts k of a query and all examples."""
    return f"""ex as {EXAMPLES}, xp as ({PIECES.format(fold=FOLD.format("k"), of="select example as k from ex")}), df as (select piece, 1 + ln({N_EXAMPLES + 1} / (count(*) + 1)) as rarity from xp group by piece),
 xw as (select k as example, piece, n * rarity as w from xp join df using (piece)), xn as (select example, sqrt(sum(w * w)) as norm from xw group by example),
 tp as ({PIECES.format(fold=FOLD.format("k"), of=of)}), tw as (select k, piece, n * coalesce(rarity, 1 + ln({N_EXAMPLES + 1})) as w from tp left join df using (piece)), tn as (select k, sqrt(sum(w * w)) as norm from tw group by k),
 near as (select t.k, x.example, ex.ord, round(round(sum(t.w * x.w) / any_value(tn.norm) / any_value(xn.norm), 10), 4) as similarity from tw t join xw x using (piece) join tn on tn.k = t.k join xn on xn.example = x.example join ex on ex.example = x.example group by t.k, x.example, ex.ord)"""


@query("text_similarity_topk", f"with {cosine('select distinct p_name as k from part')} select k as text, example, similarity, cast(row_number() over (partition by k order by similarity desc, ord, example) as int) as rank from near qualify rank <= 2")
def text_similarity_topk(spark, d):
    return M.top_similar(S.table(spark, d, "part").select(F.col("p_name").alias("text")), M.examples(spark), 2)


@query("categorized_by_similarity", f"""{SAID}, {RULED}, {cosine("select distinct said as k from ruled where ord is null")}, best as (select k, ord, similarity from near where similarity >= 0.52 qualify row_number() over (partition by k order by similarity desc, ord, example) = 1),
 rl as {RULES}, c as (select r.input_id, r.seq, r.direction, rl.category as rc, rl.subcategory as rs, ex.category as ec, ex.subcategory as es, b.similarity from rows_ r join ruled u using (description) left join rl on rl.ord = u.ord left join best b on b.k = u.said and u.ord is null left join (select distinct ord, category, subcategory from ex) ex on ex.ord = b.ord)
select input_id, seq, case when direction = 'credit' then 'income_or_refund' else coalesce(rc, ec, 'other') end as category, case when direction = 'credit' then 'credit_transaction' else coalesce(rs, es, 'uncategorized') end as subcategory,
 case when direction = 'credit' then 0.97 when rc is not null then 0.94 when ec is not null then least(0.90, similarity) else 0.35 end::double as confidence, case when direction = 'credit' then 'direction' when rc is not null then 'rule' when ec is not null then 'embedding' else 'fallback' end as method from c""")
def categorized_by_similarity(spark, d):
    t = S.described(txn(spark, d))
    return A.categorized(t, M.similar_texts(t)).select("input_id", "seq", "category", "subcategory", F.col("category_confidence").alias("confidence"), "method")


@query("rule_token_index", f"{SAID}, {RULED}, rl as {RULES} select input_id, seq, coalesce(category, 'other') as category, subcategory from rows_ join ruled using (description) left join rl using (ord)")
def rule_token_index(spark, d):
    found = A.first_rule_by_index(S.described(txn(spark, d)))
    names = F.create_map(*(F.lit(x) for i, (c, _, sub, _) in enumerate(fixed.TAXONOMY) for x in (i, f"{c}/{sub}")))
    both = F.split(F.try_element_at(names, F.col("ord")), "/")
    return found.select("input_id", "seq", F.coalesce(F.get(both, F.lit(0)), F.lit("other")).alias("category"), F.get(both, F.lit(1)).alias("subcategory"))
