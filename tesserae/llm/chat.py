"""Preference pairs rendered for training: one prompt, and a masked completion for each side.

The prompt is the longest common prefix of turns of the chosen and the rejected conversation, rendered once; completions
are what follows on either side. A completion's mask lists the spans of characters that count for the loss, which are the
contents and ends of assistant turns. A conversation is gathered into one row, as its rendering is one anyway; those of a
pair are gathered together, by one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def _gathered(turns: DataFrame, key: Column) -> DataFrame:
    """key and every turn of it with its conv_id, in order of conv_id, turn, role and text."""
    own = F.struct("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id is not null").groupBy(key).agg(F.sort_array(F.collect_list(own)).alias("turns"))


def _bare(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of role and text in order of turn. Null roles and texts are empty, null turns come first,
    equal numbers are ordered by role and text, and turns without a conv_id are left out."""
    return _gathered(turns, F.col("conv_id")).select("conv_id", _bare(F.col("turns")).alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(BREAK), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Spans start-end of the characters of assistant turns, after their heads."""
    head = len(START) + len(BREAK)

    def step(done: Column, t: Column) -> Column:
        begin = done["at"] + F.length(t["role"]) + head
        end = begin + F.length(t["text"]) + len(END)
        span = F.array(F.concat(begin.cast("string"), F.lit("-"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.aggregate(turns, begun, step, lambda done: F.array_join(done["spans"], ","))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, prompt, and for chosen and rejected a completion and its mask, from pair_id, chosen and rejected (arrays of role and text; null is empty)."""
    none = F.array().cast("array<struct<role: string, text: string>>")
    pairs = pairs.select("pair_id", *(F.coalesce(side, none).alias(side) for side in ("chosen", "rejected")))
    at = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b)), False).cast("int")
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    pairs = pairs.withColumn("common", F.when(at > 0, at - 1).otherwise(shorter))
    rest = {side: F.slice(side, F.col("common") + 1, F.greatest(F.size(side), F.lit(1))) for side in ("chosen", "rejected")}
    columns = [c for side, turns in rest.items() for c in (_rendered(turns).alias(f"{side}_completion"), _mask(turns).alias(f"{side}_mask"))]
    return pairs.select("pair_id", F.col("common").cast("long").alias("n_common"), _rendered(F.slice("chosen", 1, F.col("common"))).alias("prompt"), *columns)


def swapped_pairs(turns: DataFrame) -> DataFrame:
    """A pair for each conversation: chosen is the conversation, and rejected has the last assistant turn of its neighbour in
    place of its own. Neighbours are the ids 2n and 2n + 1; without a neighbour's turn, rejected ends before it."""
    two = _gathered(turns, F.shiftright("conv_id", 1).alias("two")).withColumn("pair_id", F.explode(F.array_distinct("turns.conv_id")))

    def of(conv_id: Column) -> Column:
        return _bare(F.filter("turns", lambda t: t["conv_id"] == conv_id))

    both = two.select("pair_id", of(F.col("pair_id")).alias("turns"), of(F.col("pair_id").bitwiseXOR(F.lit(1))).alias("theirs"))
    both = both.withColumn("other", F.try_element_at(F.filter("theirs", lambda t: t["role"] == TRAINED), F.lit(-1)))
    place = F.coalesce(F.expr(f"array_max(transform(turns, (t, i) -> if(t.role = '{TRAINED}', i, -1)))"), F.lit(-1))
    begin = F.slice("turns", 1, F.when(place >= 0, place).otherwise(F.size("turns")))
    rejected = F.when(F.col("other").isNull(), begin).otherwise(F.concat(begin, F.array("other")))
    return both.select("pair_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_pairs(swapped_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {"op9_chat": op9_chat}


def _side(name: str, source: str) -> str:
    """SQL for a side's rest: its text and the spans of its mask, by running lengths."""
    return f"""{name}_each as (select conv_id, i, role, '{START}' || role || chr(10) || text || '{END[:-1]}' || chr(10) as t, length(text) + {len(END)} as tail from {source} s join lcp using (conv_id) where i > n_common),
{name} as (select conv_id, string_agg(t, '' order by i) as completion, coalesce(string_agg(cast(stop - tail as varchar) || '-' || cast(stop as varchar), ',' order by i) filter (role = '{TRAINED}'), '') as mask
    from (select *, cast(sum(length(t)) over (partition by conv_id order by i) as bigint) as stop from {name}_each) group by conv_id)"""


ORACLES = {
    "op9_chat": f"""
with own as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
cut as (select conv_id, coalesce(max(i) filter (role = '{TRAINED}') - 1, max(i)) as keep from own group by conv_id),
answer as (select xor(conv_id, 1) as conv_id, arg_max(text, i) as text from own where role = '{TRAINED}' group by conv_id),
other as (select own.* from own join cut using (conv_id) where i <= keep union all select conv_id, keep + 1, '{TRAINED}', answer.text from cut join answer using (conv_id)),
lcp as (select c.conv_id, coalesce(min(case when o.i is null or o.role <> c.role or o.text <> c.text then c.i end) - 1, max(c.i)) as n_common
        from own c left join other o on o.conv_id = c.conv_id and o.i = c.i group by c.conv_id),
prompt as (select conv_id, string_agg('{START}' || role || chr(10) || text || '{END[:-1]}' || chr(10), '' order by i) as prompt from own join lcp using (conv_id) where i <= n_common group by conv_id),
{_side("c", "own")},
{_side("r", "other")}
select conv_id as pair_id, cast(n_common as bigint) as n_common, coalesce(prompt, '') as prompt, coalesce(c.completion, '') as chosen_completion, coalesce(c.mask, '') as chosen_mask,
       coalesce(r.completion, '') as rejected_completion, coalesce(r.mask, '') as rejected_mask
from lcp left join prompt using (conv_id) left join c using (conv_id) left join r using (conv_id)"""
}
