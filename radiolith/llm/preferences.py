"""Preference pairs of conversations as a shared prompt and two masked completions. DataFrame operations only.

The turns that the chosen and the rejected conversation have in common from the start on, as many as
there are, are rendered once as the prompt; what is left of each is rendered as its completion. A mask names
the code points of a completion to learn from: the assistant's texts with their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: What stands before a turn's role, between role and text, and after the text.
OPEN, BETWEEN, CLOSE = "<|", "|>\n", "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(BETWEEN))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def render(turns: Column) -> Column:
    """The text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column, learn: str = "assistant") -> Column:
    """Spans ``start:end`` of the rendered turns of role ``learn``, comma-joined."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        lo = acc["at"] + F.length(_head(t))
        hi = lo + F.length(_body(t))
        spans = F.when(t["role"] == learn, F.array_append(acc["spans"], F.concat(lo.cast("string"), F.lit(":"), hi.cast("string")))).otherwise(acc["spans"])
        return F.struct(hi.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, begin, add, lambda acc: F.array_join(acc["spans"], ","))


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` in the order of turn, role and text; nulls first. Rows without a ``conv_id`` belong to no conversation."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def exchanged_replies(turns: DataFrame) -> DataFrame:
    """Pairs ``(conv_id, chosen, rejected)`` of neighbours, conversations whose ids differ in the last bit.

    ``chosen`` is a conversation up to its last assistant turn. ``rejected`` is the same up to one of its assistant turns, which
    one goes by the id (half of it modulo their number), and there takes the neighbour's last assistant text and ends.
    Conversations without an assistant turn, or whose neighbour is not there or has none, make no pair.
    """
    conv = conversations(turns)
    at = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant")
    conv = conv.withColumn("at", at).where("size(at) > 0").withColumn("chosen", F.slice("turns", 1, F.element_at("at", -1)))
    which = F.pmod(F.floor(F.col("conv_id") / 2), F.size("at")).cast("int") + 1
    conv = materialize(conv.select("conv_id", "chosen", F.element_at("at", which).alias("n")), "pref-conversations")
    reply = conv.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("to"), F.element_at("chosen", -1)["text"].alias("reply"))
    met = conv.join(reply, conv["conv_id"] == reply["to"])
    other = F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("text"))
    return met.select("conv_id", "chosen", F.array_append(F.slice("chosen", 1, F.col("n") - 1), other).alias("rejected"))


def format_pairs(pairs: DataFrame, learn: str = "assistant", id_col: str = "conv_id") -> DataFrame:
    """``(conv_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask)`` of pairs of arrays of ``struct<role, text>``.

    Two nulls count as equal; null roles and texts render as nothing; a null array counts as empty; equal
    conversations have empty completions. Repeated ids are each formatted. Other columns are not kept.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    a, b = F.coalesce(F.col("chosen"), empty), F.coalesce(F.col("rejected"), empty)
    same = F.zip_with(a, b, lambda x, y: (x["role"].eqNullSafe(y["role"])) & x["text"].eqNullSafe(y["text"]) & x.isNotNull() & y.isNotNull())
    pairs = pairs.select(F.col(id_col).alias("conv_id"), a.alias("a"), b.alias("b"), same.alias("same"))
    differs = F.array_position("same", False)
    pairs = pairs.withColumn("n_common", F.when(differs > 0, differs - 1).otherwise(F.size("same")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    return pairs.select(
        "conv_id", "n_common", render(F.slice("a", 1, F.col("n_common"))).alias("prompt"), render(rest("a")).alias("chosen"), mask(rest("a"), learn).alias("chosen_mask"), render(rest("b")).alias("rejected"), mask(rest("b"), learn).alias("rejected_mask")
    )


ORACLE_SQL = """
with c as (
  select conv_id, list(struct_pack(role := role, text := text) order by turn nulls first, role nulls first, text nulls first) as turns
  from conversations where conv_id is not null group by conv_id),
l as (select conv_id, turns, [i for i in range(1, len(turns) + 1) if turns[i].role = 'assistant'] as pos from c),
k as (select conv_id, turns[1:pos[len(pos)]] as a, pos[conv_id // 2 % len(pos) + 1] as n, turns[pos[len(pos)]].text as reply from l where len(pos) > 0),
p as (
  select k.conv_id, k.a, list_append(k.a[1:k.n - 1], struct_pack(role := 'assistant', text := o.reply)) as b
  from k join k o on o.conv_id = xor(k.conv_id, 1)),
d as (select *, list_min([i for i in range(1, len(a) + 1) if i > len(b) or a[i].role is distinct from b[i].role or a[i].text is distinct from b[i].text]) as first_off from p),
m as (select conv_id, a, b, cast(case when first_off is null then len(a) else first_off - 1 end as integer) as n_common from d),
r as (
  select conv_id, n_common, a[1:n_common] as pre, a[n_common + 1:] as ca, b[n_common + 1:] as cb from m),
t as (
  select *, [concat('<|', coalesce(x.role, ''), '|>\n') for x in ca] as ha, [concat(coalesce(x.text, ''), '<|end|>\n') for x in ca] as ta,
         [concat('<|', coalesce(x.role, ''), '|>\n') for x in cb] as hb, [concat(coalesce(x.text, ''), '<|end|>\n') for x in cb] as tb from r)
select conv_id, n_common,
  array_to_string([concat('<|', coalesce(x.role, ''), '|>\n', coalesce(x.text, ''), '<|end|>\n') for x in pre], '') as prompt,
  array_to_string([concat(ha[i], ta[i]) for i in range(1, len(ca) + 1)], '') as chosen,
  array_to_string([concat(coalesce(list_sum([len(ha[j]) + len(ta[j]) for j in range(1, i)]), 0) + len(ha[i]), ':', coalesce(list_sum([len(ha[j]) + len(ta[j]) for j in range(1, i)]), 0) + len(ha[i]) + len(ta[i])) for i in range(1, len(ca) + 1) if ca[i].role = 'assistant'], ',') as chosen_mask,
  array_to_string([concat(hb[i], tb[i]) for i in range(1, len(cb) + 1)], '') as rejected,
  array_to_string([concat(coalesce(list_sum([len(hb[j]) + len(tb[j]) for j in range(1, i)]), 0) + len(hb[i]), ':', coalesce(list_sum([len(hb[j]) + len(tb[j]) for j in range(1, i)]), 0) + len(hb[i]) + len(tb[i])) for i in range(1, len(cb) + 1) if cb[i].role = 'assistant'], ',') as rejected_mask
from t
"""
