"""The ratio of ``difflib.SequenceMatcher`` as SQL: matching blocks by recursion over tables.

Equal characters of two strings lie on diagonals (position in the first minus position in the second); a run of them is an *island*. The longest
block within a range of both strings is the longest island clipped to the range, the earliest in the first string among equals, then in the second.
It splits the range into what is before and behind it in both strings, and so on; twice the matched characters over all characters is the ratio.
Popular characters (more than 1 % of a second string of 200 characters or more) start no block, but a block grows over them on either side.
"""

from __future__ import annotations


def ratio_ctes(pairs: str, name: str = "ratio") -> str:
    """Common table expressions (for a ``with recursive``) that end in ``name(a, b, r)``: the ratio of each distinct
    pair of strings in ``pairs(a, b)``, in that order."""
    n = name
    return f"""
{n}_in as (select distinct a, b from {pairs} where a is not null and b is not null),
{n}_p as (select row_number() over () as pid, a, b from {n}_in where a <> b and a <> '' and b <> ''),
{n}_a as (select pid, i, substr(a, i + 1, 1) as ch from (select pid, a, unnest(range(length(a))) as i from {n}_p)),
{n}_b as (select pid, j, ch, len >= 200 and count(*) over (partition by pid, ch) > len // 100 + 1 as popular
  from (select pid, j, len, substr(b, j + 1, 1) as ch from (select pid, b, length(b) as len, unnest(range(length(b))) as j from {n}_p))),
{n}_points as (select pid, x.i, x.i - y.j as d, popular, x.i - row_number() over (partition by pid, x.i - y.j order by x.i) as island
  from {n}_a x join {n}_b y using (pid, ch)),
{n}_runs as (select pid, d, min(i) as s, max(i) as e, island from {n}_points group by pid, d, island),
{n}_seeds as (select pid, d, min(i) as s, max(i) as e, any_value(whole_s) as whole_s, any_value(whole_e) as whole_e
  from (select p.pid, p.d, p.i, r.s as whole_s, r.e as whole_e, p.i - row_number() over (partition by p.pid, p.d order by p.i) as island
        from {n}_points p join {n}_runs r on r.pid = p.pid and r.d = p.d and r.island = p.island where not p.popular)
  group by pid, d, island),
{n}_blocks(pid, alo, ahi, blo, bhi, i, j, k) as (
  select pid, 0::bigint, length(a), 0::bigint, length(b), length(a), length(b), 0::bigint from {n}_p
  union all
  select pid, alo, ahi, blo, bhi, i, j, k from (
    select pid, alo, ahi, blo, bhi,
      case when best is not null then greatest(best.whole_s, alo, blo + best.d) else alo end as i,
      case when best is not null then greatest(best.whole_s, alo, blo + best.d) - best.d else blo end as j,
      case when best is not null then least(best.whole_e, ahi - 1, bhi - 1 + best.d) - greatest(best.whole_s, alo, blo + best.d) + 1
           when first_e is not null then least(first_e, ahi - 1, bhi - 1 + alo - blo) - alo + 1 else 0 end as k
    from (
      select c.pid, c.alo, c.ahi, c.blo, c.bhi, max(f.e) as first_e,
        min(struct_pack(short := -(least(r.e, c.ahi - 1, c.bhi - 1 + r.d) - greatest(r.s, c.alo, c.blo + r.d) + 1), i := greatest(r.s, c.alo, c.blo + r.d),
                        j := greatest(r.s, c.alo, c.blo + r.d) - r.d, d := r.d, whole_s := r.whole_s, whole_e := r.whole_e))
          filter (r.pid is not null and least(r.e, c.ahi - 1, c.bhi - 1 + r.d) >= greatest(r.s, c.alo, c.blo + r.d)) as best
      from (select pid, case when side = 0 then alo else i + k end as alo, case when side = 0 then i else ahi end as ahi,
              case when side = 0 then blo else j + k end as blo, case when side = 0 then j else bhi end as bhi
            from {n}_blocks, (values (0), (1)) sides(side)) c
        left join {n}_seeds r on r.pid = c.pid and r.s < c.ahi and r.e >= c.alo
        left join {n}_runs f on f.pid = c.pid and f.d = c.alo - c.blo and f.s <= c.alo and f.e >= c.alo
      where c.alo < c.ahi and c.blo < c.bhi
      group by c.pid, c.alo, c.ahi, c.blo, c.bhi))
  where k > 0),
{n} as (
  select a, b, coalesce(2.0 * (select sum(k) from {n}_blocks x where x.pid = p.pid) / (length(a) + length(b)), 0.0)::double as r from {n}_p p
  union all select a, b, case when a = b then 1.0 else 0.0 end from {n}_in where a = b or a = '' or b = '')"""
