"""op3: log probability of every document under a Katz model of order three of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.katz import score


def digits(x: Column, n: int = 10) -> Column:
    """x to n significant digits, so that sums in another order give the same number."""
    power = F.pow(F.lit(10.0), F.lit(n - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x * power) / power)


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.withColumns({c: digits(F.col(c)) for c in ("base_score", "score")})


#: CRC-32 by its byte table (polynomial 3988292384, reflected). A tab stands for a beginning and a space for the end, neither of which is in a word.
SQL = r"""
with bits as (
    select n, list_reduce(range(0, 9), lambda c, i: case when i = 0 then c when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n) as v
    from (select unnest(range(0, 256))::bigint as n)
), crc_table as (
    select list(v order by n) as t from bits
), ids as (
    select row_number() over () as row_id, doc_id, text, hex(encode(coalesce(doc_id::varchar, ''))) as h from documents
), docs as (
    select row_id, doc_id,
           xor(list_reduce(list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::bigint),
                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 5 = 1 as held_out,
           list_concat(list_concat([chr(9), chr(9)], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')), [' ']) as s
    from ids, crc_table
), tokens as (
    select row_id, held_out, s[i] as w, s[i - 1] as v, s[i - 2] as u from (select *, unnest(range(3, len(s) + 1)) as i from docs)
), training as (
    select * from tokens where not held_out
), c1 as (
    select w, count(*) as c from training group by all
), c2 as (
    select v, w, count(*) as c from training group by all
), c3 as (
    select u, v, w, count(*) as c from training group by all
), of_counts as (
    select level, c as r, count(*)::double as n
    from (select 1 as level, c from c1 union all select 2, c from c2 union all select 3, c from c3) where c <= 6 group by all
), grid as (
    select l.level, g.r, coalesce(o.n, 0) as n
    from (select unnest([1, 2, 3]) as level) l cross join (select unnest(range(1, 7)) as r) g left join of_counts o on o.level = l.level and o.r = g.r
), raw as (
    select a.level, a.r, a.n, b.n as after, f.n as ones, case when f.n > 0 then 6 * z.n / f.n else 1 end as common
    from grid a join grid b on a.level = b.level and b.r = a.r + 1 join grid f on a.level = f.level and f.r = 1 join grid z on a.level = z.level and z.r = 6
), guessed as (
    select *, case when n > 0 and common < 1 then ((r + 1) * after / (r * n) - common) / (1 - common) end as d from raw
), discounts as (
    select level, r, n, case when d > 0 and d < 1 then d else (r - 0.5) / r end as d from guessed
), unigrams as (
    select (select sum(c) from c1) - cut + freed as total, freed from (select cut, case when cut = 0 then 0.5 else cut end as freed from (select sum(n * r * (1 - d)) as cut from discounts where level = 1))
), s1 as (
    select w, c, c * coalesce(d, 1) as kept from c1 left join discounts on level = 1 and r = c
), s2 as (
    select v, w, c, c * coalesce(d, 1) as kept from c2 left join discounts on level = 2 and r = c
), s3 as (
    select u, v, w, c, c * coalesce(d, 1) as kept from c3 left join discounts on level = 3 and r = c
), total1 as (
    select v, sum(c) as c from c2 group by v
), total2 as (
    select u, v, sum(c) as c from c3 group by u, v
), alpha1 as (
    select s2.v, (sum(s2.c - s2.kept) + 0.01) / (sum(s2.c) + 0.01) * any_value(total) / (any_value(total) - sum(s1.kept)) as alpha
    from s2 join s1 using (w) cross join unigrams group by s2.v
), alpha2 as (
    select s3.u, s3.v, (sum(s3.c - s3.kept) + 0.01) / (sum(s3.c) + 0.01) * (any_value(t.c) + 0.01) / (any_value(t.c) + 0.01 - sum(s2.kept)) as alpha
    from s3 join s2 on s2.v = s3.v and s2.w = s3.w join total1 t on t.v = s3.v group by s3.u, s3.v
), scored as (
    select row_id, held_out, s1.c as c, coalesce(s1.kept / total, freed / total) as p1,
           case when s2.c > 0 then s2.kept / (t1.c + 0.01) else coalesce(a1.alpha, 1) * p1 end as p2,
           case when s3.c > 0 then s3.kept / (t2.c + 0.01) else coalesce(a2.alpha, 1) * p2 end as p3
    from tokens t cross join unigrams left join s1 on s1.w = t.w left join s2 on s2.v = t.v and s2.w = t.w left join s3 on s3.u = t.u and s3.v = t.v and s3.w = t.w
    left join total1 t1 on t1.v = t.v left join total2 t2 on t2.u = t.u and t2.v = t.v left join alpha1 a1 on a1.v = t.v left join alpha2 a2 on a2.u = t.u and a2.v = t.v
), summed as (
    select row_id, count(*) as n_tokens, count(c) as n_known,
           sum(log10((coalesce(c, 0) + 0.5) / ((select sum(c) from c1) + 0.5 * ((select count(*) from c1) + 1)))) as base, sum(log10(p3)) as score
    from scored group by row_id
)
select doc_id, held_out, n_tokens, n_known, (select coalesce(sum(c), 0) from c1)::bigint as train_tokens,
       round(base * pow(10.0, 9 - floor(log10(abs(base))))) / pow(10.0, 9 - floor(log10(abs(base)))) as base_score,
       round(score * pow(10.0, 9 - floor(log10(abs(score))))) / pow(10.0, 9 - floor(log10(abs(score)))) as score
from summed join docs using (row_id)
"""
