"""Preference formatting (operator 8), native.

Input: turns of chosen and rejected conversations. The longest common prefix of turns (equal role and text) is rendered
once as the prompt; what follows on either side becomes its completion, with the spans a trainer learns from:
the contents of assistant turns with their end mark. Everything else (headers, other roles, the prompt) is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import let

#: The template of one turn.
HEAD, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def turns_by_conversation(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                          text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order as ``array<struct<turn, role, text>>``.

    Equal repeated turns count once; different turns of one number follow by role, then text. Null roles and texts are
    empty, null turn numbers come first. Rows without an id form a conversation with a null id.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_set(turn)).alias("turns"))


def _common(chosen: Column, rejected: Column) -> Column:
    """Number of equal turns at the start of both."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    return let(same, lambda s: F.when(F.array_position(s, False) > 0, F.array_position(s, False) - 1).otherwise(F.size(s)).cast("int"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _trained(turns: Column) -> Column:
    """Spans (code points, end exclusive) of the assistant contents in the rendered completion."""
    lengths = F.transform(turns, lambda t: F.char_length(_rendered(t)))

    def spans(s: Column) -> Column:
        starts = F.transform(s["turns"], lambda t, i: F.struct(
            (F.aggregate(F.slice(s["lengths"], F.lit(1), i), F.lit(0), lambda a, x: a + x)
             + F.char_length(t["role"]) + len(HEAD) + len(MIDDLE)).alias("start"), t.alias("t")))
        return F.transform(F.filter(starts, lambda x: x["t"]["role"] == "assistant"), lambda x: F.struct(
            x["start"].alias("start"), (x["start"] + F.char_length(x["t"]["text"]) + len(END.rstrip("\n"))).alias("end")))

    return let(F.struct(turns.alias("turns"), lengths.alias("lengths")), spans)


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected), arrays of turns as above -> pair_id, ``n_common``, ``prompt``, ``chosen``, ``rejected`` (completions) and
    ``chosen_train``, ``rejected_train`` (spans). A null side is an empty conversation; equal sides give two empty completions.
    Each row is a pair of its own."""
    empty = F.array().cast("array<struct<turn:int,role:string,text:string>>")
    sides = pairs.select("pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    cut = sides.select("*", _common(F.col("c"), F.col("r")).alias("n"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    return cut.select("pair_id", F.col("n").cast("bigint").alias("n_common"), _render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
                      _render(rest(F.col("c"))).alias("chosen"), _render(rest(F.col("r"))).alias("rejected"),
                      _trained(rest(F.col("c"))).alias("chosen_train"), _trained(rest(F.col("r"))).alias("rejected_train"))


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from a table without preferences: chosen is a conversation, rejected the same up to its last assistant turn, and from
    there on the turns of the conversation with the next id (none if there is none)."""
    own = conversations.select(F.col("conv_id").cast("bigint").alias("pair_id"), F.col("turns").alias("chosen"))
    other = conversations.where("conv_id is not null").select(
        (F.col("conv_id") - 1).cast("bigint").alias("next_of"), F.col("turns").alias("next"))
    both = own.join(other, own["pair_id"] == other["next_of"], "left")
    last = F.coalesce(F.array_max(F.transform("chosen", lambda t, i: F.when(t["role"] == "assistant", i))), F.size("chosen"))
    tail = F.when(F.col("next").isNotNull(), F.slice("next", last + 1, F.greatest(F.size("next") - last, F.lit(0)))).otherwise(F.slice("chosen", F.lit(1), F.lit(0)))
    return both.select("pair_id", "chosen", F.concat(F.slice("chosen", F.lit(1), last), tail).alias("rejected"))


def _span_text(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))


def op8(spark, sf_dir: str) -> DataFrame:
    """Query: every conversation as a preference pair."""
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = format_preferences(preference_pairs(turns_by_conversation(turns)))
    return out.select("pair_id", "n_common", "prompt", "chosen", "rejected",
                      _span_text(F.col("chosen_train")).alias("chosen_train"), _span_text(F.col("rejected_train")).alias("rejected_train"))


OP8_SQL = r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 i, role, text
           from (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations)),
n as (select conv_id, coalesce(max(i) filter (role = 'assistant'), count(*)) last from t group by conv_id),
c as (select conv_id p, 'c' side, i, role, text from t),
r as (select conv_id p, 'r' side, t.i, role, text from t join n using (conv_id) where t.i < n.last
      union all select n.conv_id, 'r', t.i, role, text from n join t on t.conv_id = n.conv_id + 1 where t.i >= n.last),
d as (select p, coalesce(min(i) filter (m), max(i) + 1) n from (
      select coalesce(c.p, r.p) p, coalesce(c.i, r.i) i, (c.role = r.role and c.text = r.text) is not true m
      from c full join r on c.p = r.p and c.i = r.i) group by p),
x as (select s.p, side, s.i, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) o, s.i < d.n as common, d.n
      from (select * from c union all select * from r) s join d on s.p = d.p),
y as (select *, coalesce(sum(length(o)) over (partition by p, side order by i rows between unbounded preceding and 1 preceding), 0) b
      from x where not common),
z as (select p, string_agg(o, '' order by i) filter (side = 'c') c, string_agg(o, '' order by i) filter (side = 'r') r,
             string_agg(cast(b + 4 + length(role) + 1 as bigint) || ':' || cast(b + length(o) - 1 as bigint), ',' order by i) filter (side = 'c' and role = 'assistant') ct,
             string_agg(cast(b + 4 + length(role) + 1 as bigint) || ':' || cast(b + length(o) - 1 as bigint), ',' order by i) filter (side = 'r' and role = 'assistant') rt
      from y group by p),
q as (select p, string_agg(o, '' order by i) prompt from x where common and side = 'c' group by p)
select d.p pair_id, cast(d.n as bigint) n_common, coalesce(prompt, '') prompt, coalesce(c, '') chosen, coalesce(r, '') rejected,
       coalesce(ct, '') chosen_train, coalesce(rt, '') rejected_train
from d left join z on d.p = z.p left join q on d.p = q.p
"""
