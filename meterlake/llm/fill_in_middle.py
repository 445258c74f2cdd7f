"""Fill-in-the-middle examples: a text is cut into units, and the piece between two cuts moves to its end.

The units of a grammar are found by where they meet: each grammar is a set of pairs of character classes, and a boundary is
any place between a character of the first and one of the second class. Its regular expression is a lookbehind and a
lookahead, which take no characters, so Spark's split gives back every piece unchanged; whatever is cut can be joined
again. Splitting the empty text gives one empty piece: it has no unit, and is handled apart.

Where a text is cut, and in which form it is written, follows from a digest of seed and doc_id alone, so any run decides
alike. Only SQL functions are used: no Python, no shuffle.

Edge cases: null counts as empty; empty texts, and those that hold a mark already, stay as they are (form plain); a row
without doc_id is decided by the seed alone, repeated rows alike; other columns are kept (transform) or not read (op12);
texts of any length are cut as a whole; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import table, unused, whole

SPACE = r"\x20\x09-\x0D"
ANY = r"\s\S"
#: Where units meet: classes of the character before and of the one after a boundary.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "token": ((f"^{SPACE}", SPACE),),
    "word": ((r"^\w", r"\w"), (r"\w", r"^\w")),
    "line": ((r"\n", ANY),),
    "sentence": ((r".!?", SPACE),),
    "character": ((ANY, ANY),),
}
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Rule:
    """How examples are made: the unit, the seed, the share of texts in percent that are changed, and of those the share that
    has the suffix first."""

    unit: str = "token"
    seed: int = 42
    changed: int = 50
    suffix_first: int = 80


def boundary(unit: str) -> str:
    """The zero-width pattern of a grammar's boundaries."""
    return "|".join(f"(?<=[{before}])(?=[{after}])" for before, after in GRAMMARS[unit])


def units(text: Column, unit: str) -> Column:
    """The pieces of a text, which joined give the text; none for the empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit), -1))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits each, from the digest of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, rule: Rule = Rule(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs and what became of each text: fim_n (its units), fim_form (plain, psm, spm), fim_prefix, fim_middle, fim_suffix
    (null if plain) and fim_output."""
    pieces, given, first, second, kind, order = (unused(docs, f"__{c}") for c in ("pieces", "given", "first", "second", "kind", "order"))
    rows = docs.withColumn(given, whole(text))
    draw = draws(F.col(doc_id), rule.seed)
    rows = rows.withColumns({pieces: units(F.col(given), rule.unit)} | dict(zip((first, second, kind, order), draw, strict=True)))
    rows = rows.withColumn("fim_n", F.size(pieces).cast("long"))
    marked = F.lit(False)
    for m in MARKS:
        marked |= F.contains(given, F.lit(m))
    form = F.when((F.col(given) == "") | marked | (F.col(kind) % 100 >= rule.changed), "plain").when(F.col(order) % 100 < rule.suffix_first, "spm").otherwise("psm")
    cuts = [(F.col(c) % (F.col("fim_n") + 1)).cast("int") for c in (first, second)]
    rows = rows.withColumns({"fim_form": form, first: F.least(*cuts), second: F.greatest(*cuts)})
    part = lambda a, b: F.when(F.col("fim_form") != "plain", F.array_join(F.slice(pieces, a + 1, b - a), ""))
    rows = rows.withColumns({"fim_prefix": part(F.lit(0), F.col(first)), "fim_middle": part(F.col(first), F.col(second)), "fim_suffix": part(F.col(second), F.col("fim_n").cast("int"))})
    p, m, s = F.col("fim_prefix"), F.col("fim_middle"), F.col("fim_suffix")
    output = F.when(F.col("fim_form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m))
    output = output.when(F.col("fim_form") == "spm", F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)).otherwise(F.col(given))
    return rows.withColumn("fim_output", output).drop(pieces, given, first, second, kind, order)


def restored(examples: DataFrame, into: str = "fim_restored") -> DataFrame:
    """The rows of transform() and the text that each output was made of, from output and form alone.

    No text that is changed holds a mark, nor can one arise where a mark meets a piece, for only the first character of a
    mark opens one; so such an output has three marks.
    """
    parts, psm = unused(examples, "__parts"), F.col("fim_form") == "psm"
    rows = examples.withColumn(parts, F.split("fim_output", "|".join(MARKS), -1))
    found = F.concat(F.when(psm, F.col(parts)[1]).otherwise(F.col(parts)[2]), F.col(parts)[3], F.when(psm, F.col(parts)[2]).otherwise(F.col(parts)[1]))
    return rows.withColumn(into, F.when(F.col("fim_form") == "plain", F.col("fim_output")).otherwise(found)).drop(parts)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = restored(transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return docs.select(
        "doc_id",
        F.col("fim_n").alias("n"),
        F.col("fim_form").alias("form"),
        F.length("fim_prefix").cast("long").alias("prefix_chars"),
        F.length("fim_middle").cast("long").alias("middle_chars"),
        digest("fim_output").alias("output_sha256"),
        digest("fim_restored").alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM given
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parted AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parted
"""
