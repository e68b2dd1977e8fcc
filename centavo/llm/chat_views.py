"""Chat formatting by multi-party perspective rotation, DataFrame functions only.

For every participant of a conversation (every role but system) the dialogue is rendered with that speaker as
assistant, the others as named users and system turns as system. Masks are the character ranges, within the rendered part, of
what the assistant says: what a model is trained on.

A long dialogue comes in parts of at most PART turns, and its texts are never gathered beyond a part; char_offset says where a part begins.
It is summed over the parts' lengths alone, in two levels (BLOCK spans of turns, then blocks). Texts move by conversation and span of turn numbers, never by
conversation alone: that only ids do (a row for PART turns and participant). Turns go by number, then role and text (null numbers first). Turns of PART successive numbers
are ordered in one task: of a span's numbers that repeat, and of turns without a number, a task sees all. These are the cases in which a task's texts grow with a dialogue.

Null text: empty. Null role: the role unknown, like turns that say so. Null conversation: one of its own. Repeated rows are turns like others. Marks
of the template within a text stay as they are: masks are by position, so they cannot be mistaken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PART, BLOCK = 64, 1024
START, STOP = "<|im_start|>", "<|im_end|>\n"


def perspectives(turns: DataFrame, part: int = PART) -> DataFrame:
    """turns: (conv_id, turn, role, text). Returns (conv_id, perspective, part, char_offset, n_turns, rendered, masks)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.floor(F.col("turn") / part), F.lit(-1)).alias("span"))
    order = Window.partitionBy("conv_id", "span").orderBy("turn", "role", "text")
    rows = rows.withColumn("sub", F.floor((F.row_number().over(order) - 1) / part))
    parts = rows.groupBy("conv_id", "span", "sub").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    people = rows.where("role != 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    spans = rows.select("conv_id", "span").distinct()
    seen = _null_safe(parts, _null_safe(spans, people, ["conv_id"]), ["conv_id", "span"])  # texts move by conversation and span, ids alone by conversation
    heads = F.transform("said", lambda s: F.concat(F.lit(START), _label(s["role"]), F.lit("\n")))
    seen = seen.withColumn("heads", heads)
    seen = seen.withColumn("rendered", F.concat_ws("", F.zip_with("heads", "said", lambda h, s: F.concat(h, s["text"], F.lit(STOP)))))
    step = lambda at, x: F.struct((at["at"] + x["head"] + x["body"] + len(STOP)).alias("at"), F.when(x["mine"], F.concat(at["masks"], F.array(F.struct((at["at"] + x["head"]).alias("begin"), (at["at"] + x["head"] + x["body"]).alias("end"))))).otherwise(at["masks"]).alias("masks"))
    sizes = F.zip_with("heads", "said", lambda h, s: F.struct(F.length(h).alias("head"), F.length(s["text"]).alias("body"), (s["role"] == F.col("perspective")).alias("mine")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("masks"))
    seen = seen.withColumn("masks", F.aggregate(sizes, none, step, lambda at: at["masks"]))
    # Lengths alone: of each part as each participant sees it, without rendering it.
    at = ["conv_id", "perspective", "block"]
    seen = seen.withColumn("block", F.floor(F.col("span") / BLOCK))
    each = lambda s: (F.length(_label(s["role"])) + F.length(s["text"]) + (len(START) + 1 + len(STOP))).cast("long")
    sizes = seen.select(*at, "span", "sub", F.aggregate("said", F.lit(0).cast("long"), lambda n, s: n + each(s)).alias("n"))
    blocks = sizes.groupBy(*at).agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*at, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("parts").over(earlier), F.lit(0)).alias("p0"))
    within = Window.partitionBy(*at).orderBy("span", "sub")
    places = sizes.select(*at, "span", "sub", (F.row_number().over(within) - 1).alias("p1"), F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n1"))
    places = _null_safe(places, blocks, at).select(*at, "span", "sub", (F.col("p0") + F.col("p1")).cast("int").alias("part"), (F.col("n0") + F.col("n1")).alias("char_offset"))
    seen = _null_safe(seen, places, [*at, "span", "sub"])
    return seen.select("conv_id", "perspective", "part", "char_offset", F.size("said").alias("n_turns"), "rendered", "masks")


def _null_safe(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are equal."""
    held = more.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in more.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(held, same).drop(*[f"__{k}" for k in keys])


def _label(role: Column) -> Column:
    return F.when(role == F.col("perspective"), F.lit("assistant")).when(role == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), role))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = perspectives(table(spark, sf_dir, "conversations"))
    spans = F.concat_ws(",", F.transform("masks", lambda m: F.concat_ws("-", m["begin"].cast("string"), m["end"].cast("string"))))
    return seen.withColumn("masks", spans)


#: Conversations here are shorter than one part; parts of longer ones are tested by brute force.
ORACLE = f"""
with t as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text, cast(coalesce(floor(turn / {PART}), -1) as int) as span from conversations),
r as (select *, row_number() over (partition by conv_id, span order by turn nulls first, role, text) as n from t),
p as (select distinct conv_id, role as perspective from t where role <> 'system'),
s as (select r.conv_id, p.perspective, r.span, (r.n - 1) // {PART} as sub, r.n, r.role = p.perspective as mine, r.text,
 '{START}' || case when r.role = p.perspective then 'assistant' when r.role = 'system' then 'system' else 'user name=' || r.role end || chr(10) as head
 from r join p on r.conv_id is not distinct from p.conv_id),
o as (select *, sum(length(head) + length(text) + {len(STOP)}) over (partition by conv_id, perspective, span, sub order by n) - length(text) - {len(STOP)} as begin from s),
g as (select conv_id, perspective, span, sub, count(*) as n_turns, string_agg(head || text || '<|im_end|>' || chr(10), '' order by n) as rendered,
 coalesce(string_agg(case when mine then cast(cast(begin as bigint) as varchar) || '-' || cast(cast(begin + length(text) as bigint) as varchar) end, ',' order by n), '') as masks from o group by all)
select conv_id, perspective, cast(row_number() over w - 1 as int) as part, cast(coalesce(sum(length(rendered)) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as char_offset,
 cast(n_turns as int) as n_turns, rendered, masks from g window w as (partition by conv_id, perspective order by span, sub)"""
