"""Quality rules as a short-circuit cascade, DataFrame functions only.

``measure`` adds a text's measures. ``plan_cascade`` runs every rule on a bounded sample, takes its cost
(seconds a row) and its rejection rate, and orders rules by rejection per cost; ``cascade`` evaluates them in that
order as one CASE expression, so a text that an early rule rejects never reaches the dear ones. The order changes
the work alone, never the verdict. cascade() replaces a column __rejected_by that the documents may have; nothing else is named anew.

Null and empty texts: no words, hence rejected by the word count. Null ids, repeated rows and extra columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, stage, table

#: Fixed values of the rules.
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
MOST_SYMBOL_PERCENT, MOST_DUP_LINE_PERCENT, MOST_UPPER_PERCENT, MEAN_WORD_CHARS = 20, 50, 50, (2, 40)
#: Rows of the sample from which costs and selectivities are estimated.
SAMPLE_ROWS = 2000
#: Up to so many repeated windows are looked up one by one; beyond it the windows are sorted.
FEW = 32


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def word_chars(held: Column) -> Column:
    return F.length(F.array_join(held, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def windows(held: Column) -> Column:
    """A 64-bit hash for each 3-word window, in order."""
    n = F.size(held)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(held, i), F.get(held, i + 1), F.get(held, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def covered(starts: Column) -> Column:
    """Words that 3-word windows at these ascending positions cover."""
    return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def repeat_words(hashes: Column, repeated: Column) -> Column:
    """Words in windows found twice or more. Few repeated windows are looked up; many go through one sort by (hash, place)."""
    few = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(repeated, F.get(hashes, i)))
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    many = let(placed, lambda p: F.sort_array(F.transform(_runs(p), lambda e: e["i"])))  # a lambda would evaluate an unbound array for every element
    return F.when(F.size(repeated) == 0, F.lit(0).cast("long")).when(F.size(repeated) <= FEW, covered(few)).otherwise(covered(many))


def _runs(placed: Column) -> Column:
    """Entries of a sorted array of (h, i) whose hash a neighbour shares."""
    at = lambda j: F.get(placed, j)["h"]
    return F.filter(placed, lambda e, j: F.coalesce(at(j + 1) == e["h"], F.lit(False)) | F.coalesce(at(j - 1) == e["h"], F.lit(False)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates a value once and gives it to the body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_windows(ordered: Column) -> Column:
    """Hashes that occur twice or more, of a sorted and bound array."""
    return F.array_distinct(F.filter(ordered, lambda h, j: F.coalesce(F.get(ordered, j + 1) == h, F.lit(False))))


def n_repeat_words(held: Column) -> Column:
    return let(windows(held), lambda h: let(let(F.sort_array(h), repeated_windows), lambda r: repeat_words(h, r)))


def n_upper(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Z\u00c0-\u00de]+", ""))


def n_dup(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


Measures = dict[str, Callable[[], Column]]


def measures(text: Column, held: Column) -> Measures:
    """Each measure of a text and its words, written out where a rule asks for it."""
    return {
        "n_words": lambda: F.size(held).cast("long"),
        "n_repeat_words": lambda: n_repeat_words(held),
        "n_symbols": lambda: n_symbols(text),
        "n_upper": lambda: n_upper(text),
        "word_chars": lambda: word_chars(held),
        "lines": lambda: let(worded_lines(text), lambda x: F.struct(F.size(x).alias("n"), n_dup(x).alias("dup"))),
    }


#: Rules by name: true for a text that is rejected.
RULES: dict[str, Callable[[Measures], Column]] = {
    "few_words": lambda m: m["n_words"]() < LEAST_WORDS,
    "repeats": lambda m: 100 * m["n_repeat_words"]() > MOST_REPEAT_PERCENT * m["n_words"](),
    "symbols": lambda m: 100 * m["n_symbols"]() > MOST_SYMBOL_PERCENT * m["n_words"](),
    "capitals": lambda m: let(m["word_chars"](), lambda n: 100 * m["n_upper"]() > MOST_UPPER_PERCENT * n),
    "dup_lines": lambda m: let(m["lines"](), lambda x: 100 * x["dup"] > MOST_DUP_LINE_PERCENT * x["n"]),
    "word_length": lambda m: let(m["word_chars"](), lambda n: ~n.between(MEAN_WORD_CHARS[0] * m["n_words"](), MEAN_WORD_CHARS[1] * m["n_words"]())),
}
BASE = ("few_words", "repeats")


def plan_cascade(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules ordered by rejections per second of work, each timed alone on one bounded sample, beyond what splitting its words takes.

    A share of all rows is drawn first, so the tasks together send about the sample and not a sample each."""
    share = 2 * sample_rows / max(docs.count(), 1)
    drawn = docs.select(_text(text).alias("text"))
    sample = stage((drawn.where(F.rand(11) < share) if share < 1 else drawn).limit(sample_rows), "rule-sample")

    def timed(measure: Callable[[Column], Column]) -> tuple[float, float]:
        found, took = 0.0, []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            found = sample.agg(F.avg(let(words(F.col("text")), measure).cast("double"))).collect()[0][0] or 0.0
            took.append(time.perf_counter() - began)
        return found, min(took)

    def verdict(reject: Callable[[Measures], Column]) -> Callable[[Column], Column]:
        return lambda w: reject(measures(F.col("text"), w))

    _, floor = timed(lambda w: F.size(w))
    worth = {}
    for name, reject in RULES.items():
        share, seconds = timed(verdict(reject))
        worth[name] = share / max(seconds - floor, 1e-3)
    return sorted(RULES, key=lambda name: -worth[name])


def rejected_by(order: list[str], held: Measures, first: Column | None = None) -> Column:
    """The first rule in the order that rejects, or null; later rules are not evaluated for that text. first: a verdict known before."""
    case = F.when(first, F.lit("base")) if first is not None else F
    for name in order:
        case = case.when(RULES[name](held), F.lit(name))
    return case


def _verdict(order: list[str], text: Column) -> Column:
    """The words are split once; the optimizer would write an alias out for every rule, so they are bound."""
    return let(words(text), lambda w: rejected_by(order, measures(text, w)))


def cascade(docs: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """Adds __rejected_by to the documents' columns."""
    return docs.withColumn("__rejected_by", _verdict(order, _text(text)))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    return docs.where(_verdict(plan_cascade(docs, text), _text(text)).isNull())


def report(docs: DataFrame, order: list[str], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: every measure, the base verdict, and the cascade's verdict in its order."""
    t, col = F.col("__text"), lambda name: lambda: F.col(name)
    df = docs.select(F.col(id_column).alias("doc_id"), _text(text).alias("__text")).withColumn("__words", words(t)).withColumn("__hashes", windows(F.col("__words")))
    df = df.withColumn("__sorted", F.sort_array("__hashes")).withColumn("__repeated", repeated_windows(F.col("__sorted"))).withColumn("__lines", worded_lines(t))
    measured = {"n_words": F.size("__words").cast("long"), "word_chars": word_chars(F.col("__words")), "n_symbols": n_symbols(t), "n_dup_lines": n_dup(F.col("__lines")), "n_repeat_words": repeat_words(F.col("__hashes"), F.col("__repeated"))}
    df = df.select("doc_id", "__text", F.size("__lines").alias("__n_lines"), *[c.alias(name) for name, c in measured.items()])
    held = {name: col(name) for name in measured} | {"n_upper": lambda: n_upper(t), "lines": lambda: F.struct(F.col("__n_lines").alias("n"), F.col("n_dup_lines").alias("dup"))}
    df = df.withColumn("base_failed", RULES["few_words"](held) | RULES["repeats"](held))
    return df.withColumn("kept", rejected_by([x for x in order if x not in BASE], held, F.col("base_failed")).isNull()).drop("__text", "__n_lines")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(docs, plan_cascade(docs))


_WORD = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
with t as (select doc_id, coalesce(text, '') as t, row_number() over () as k from documents),
w as (select k, regexp_extract_all(t, '{_WORD}') as w from t),
g as (select k, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3),
h as (select k, i, count(*) over (partition by k, w[i], w[i + 1], w[i + 2]) as c from g),
r as (select k, count(distinct p) as n from (select k, i + unnest([0, 1, 2]) as p from h where c > 1) group by k),
l as (select k, count(*) as n_lines, count(*) - count(distinct line) as n from (select k, unnest(string_split(t, chr(10))) as line from t) where regexp_matches(line, '{_WORD}') group by k),
m as (select t.doc_id, t.t, cast(len(w.w) as bigint) as n_words, cast(length(regexp_replace(t.t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
 cast(length(regexp_replace(t.t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(coalesce(l.n, 0) as bigint) as n_dup_lines, coalesce(l.n_lines, 0) as n_lines,
 cast(coalesce(r.n, 0) as bigint) as n_repeat_words, length(regexp_replace(t.t, '[^A-Z\x{{c0}}-\x{{de}}]+', '', 'g')) as n_upper
 from t join w using (k) left join l using (k) left join r using (k))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words as base_failed,
 not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words or 100 * n_symbols > {MOST_SYMBOL_PERCENT} * n_words or 100 * n_upper > {MOST_UPPER_PERCENT} * word_chars
 or 100 * n_dup_lines > {MOST_DUP_LINE_PERCENT} * n_lines or word_chars < {MEAN_WORD_CHARS[0]} * n_words or word_chars > {MEAN_WORD_CHARS[1]} * n_words) as kept
from m"""
