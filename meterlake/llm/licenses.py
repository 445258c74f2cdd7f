"""License scan by ordered signature rules, with DataFrame functions only.

Each rule is a hand-written regular expression with a label, a priority (1 strongest) and keywords, one of which every
match contains; the expression is tried where one stands in the text. All matches of the rules that pass become intervals; an interval
inside one of a stronger or equally strong rule that starts no later is suppressed, so a short name within a longer
notice does not report a second license. One row stays one row: nothing is shuffled.

Edge cases: a null or empty text has no words, no labels and score 0; extra columns are not read; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import table, whole
from meterlake.llm.license_rules import MARKS, RULES, STEMS

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: What a rule of each priority is worth as evidence.
WEIGHTS = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.5}


def _size(x: Column) -> Column:
    return F.length(x)


def _words_in(marked: Column) -> Column:
    """Words of a string in which each word has a space on either side."""
    return ((_size(marked) - _size(F.replace(marked, F.lit(" "), F.lit("")))) / 2).cast("long")


def with_base(docs: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and the labels of the phrases; needs the column low."""
    # Every word stands between two spaces of its own, so that phrases side by side share none.
    marked = F.concat(F.lit(" "), F.trim(F.regexp_replace("low", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")), F.lit(" "))
    docs = docs.withColumn("marked", F.when(F.rlike("low", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")), marked).otherwise(""))
    docs = docs.withColumn("n_words", _words_in(F.col("marked")))
    places, first, last, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        text = F.lit(" " + phrase.replace(" ", "  ") + " ")
        here = F.contains("marked", text)
        places.append(F.when(here, ((_size(F.col("marked")) - _size(F.replace("marked", text, F.lit("")))) / _size(text)).cast("long")).otherwise(F.lit(0)))
        first.append(F.when(here, _words_in(F.substring_index("marked", " " + phrase.replace(" ", "  ") + " ", 1))))
        after = _words_in(F.substring_index("marked", " " + phrase.replace(" ", "  ") + " ", -1))
        last.append(F.when(here, F.col("n_words") - after - F.lit(phrase.count(" ") + 1)))
        labels.append(F.when(here, F.lit(label)))
    return docs.withColumns(
        {"n_base": reduce(Column.__add__, places).cast("long"), "first_word": F.least(*first), "last_word": F.greatest(*last), "base": F.array_compact(F.array(*labels))}
    ).drop("marked")


def _rules() -> Column:
    """The rules as one constant array."""
    rows = ", ".join(f"named_struct('label', {_quoted(r.label)}, 'priority', {r.priority}, 'pattern', {_quoted(r.pattern)})" for r in RULES)
    return F.expr(f"array({rows})")


def _passed(text: Column) -> Column:
    """The rules one of whose keywords stands in the text. Each keyword is looked for once, whatever rules it opens."""
    opened: dict[str, list[int]] = {}
    for i, r in enumerate(RULES):
        for k in r.keywords:
            opened.setdefault(k, []).append(i + 1)
    rows = ", ".join(f"named_struct('key', {_quoted(k)}, 'rules', array({', '.join(map(str, v))}))" for k, v in opened.items())
    here = F.filter(F.expr(f"array({rows})"), lambda x: F.contains(text, x["key"]))
    return F.transform(F.array_distinct(F.flatten(F.transform(here, lambda x: x["rules"]))), lambda i: F.element_at(_rules(), i))


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _running(lengths: Column) -> Column:
    """Sums up to each element. Each step adds what lies twice as far back, so n elements take n log n additions and no array grows."""
    n = F.size(lengths)

    def step(acc: Column, j: Column) -> Column:
        back = F.least(n, F.pow(F.lit(2), j).cast("int"))
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0), back), F.slice(acc, F.lit(1), n - back)), lambda a, b: a + b)

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(0), F.length(F.bin(n))), lengths, step)).otherwise(lengths)


def _intervals(text: Column, rule: Column) -> Column:
    """Start and end of every match of a rule: lengths of what lies between matches and of the matches, added up."""
    gaps = F.transform(F.split(text, rule["pattern"], -1), lambda x: _size(x))
    hits = F.transform(F.regexp_extract_all(text, F.concat(F.lit("("), rule["pattern"], F.lit(")")), F.lit(1)), lambda x: _size(x))

    def span(end: Column, hit: Column) -> Column:
        return F.struct((end - hit).alias("start"), (-end).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"), end.alias("end"))

    # One element each, so that both arrays are made once: lambdas read their arguments as often as they like.
    def placed(own: Column) -> Column:
        lengths = F.zip_with(F.slice(own["gaps"], F.lit(1), F.size(own["hits"])), own["hits"], lambda a, b: a + b)
        ends = F.transform(F.array(lengths), lambda x: _running(x))[0]
        return F.zip_with(ends, own["hits"], span)

    return F.transform(F.array(F.struct(gaps.alias("gaps"), hits.alias("hits"))), placed)[0]


def with_rules(docs: DataFrame, prefilter: bool = True) -> DataFrame:
    """Adds found: distinct (priority, label) of the intervals that no stronger one contains; needs the column low. Without the prefilter every rule is tried."""
    some = F.rlike("low", F.lit(STEMS)) if prefilter else F.lit(True)
    flat = F.regexp_replace("low", MARKS, " ")
    spans = lambda text: F.array_sort(F.flatten(F.transform(_passed(text) if prefilter else _rules(), lambda r: _intervals(text, r))))
    # Swept by start, longest first: ends[p] is the furthest end so far among rules of priority p or stronger.
    start = F.expr("named_struct('ends', array(-1, -1, -1, -1), 'kept', cast(array() as array<struct<priority:int,label:string>>))")

    def sweep(acc: Column, d: Column) -> Column:
        inside = F.element_at(acc["ends"], d["priority"]) >= d["end"]
        ends = F.transform(acc["ends"], lambda e, i: F.when(i + 1 >= d["priority"], F.greatest(e, d["end"])).otherwise(e))
        own = F.array(F.struct(d["priority"].alias("priority"), d["label"].alias("label")))
        return F.struct(ends.alias("ends"), F.when(inside, acc["kept"]).otherwise(F.array_union(acc["kept"], own)).alias("kept"))

    docs = docs.withColumn("flat", F.when(some, flat))
    kept = F.aggregate(spans(F.col("flat")), start, sweep, lambda acc: acc["kept"])
    none = F.expr("cast(array() as array<struct<priority:int,label:string>>)")
    return docs.withColumn("found", F.when(F.col("flat").isNotNull(), kept).otherwise(none)).drop("flat")


def scan(docs: DataFrame, prefilter: bool = True) -> DataFrame:
    """Per document the words, the base phrases, the labels of both and a score of the strongest evidence."""
    rows = docs.select("doc_id", F.lower(whole()).alias("low"))
    rows = with_rules(with_base(rows), prefilter)
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    best = F.array_max(F.transform("found", lambda x: F.element_at(weight, x["priority"])))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.6)).otherwise(F.lit(0.0))).alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
