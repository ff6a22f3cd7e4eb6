"""Fill-in-the-middle transformation by one counted-quantifier match per text.

``regexp_count`` gives the number n of units (lines) of a text. Two cut points
a <= b from a hash of the id go into a pattern of that row's own: possessive
``unit{a}`` and ``unit{b-a}`` groups and the rest. One ``regexp_replace`` with
this pattern captures prefix, middle and suffix and writes them in the order of
the row's form. Possessive counted groups are matched in a loop and never give
back, so a text of any number of lines needs neither stack nor backtracking.
No row leaves its partition.

Forms: ``psm`` is P prefix S suffix M middle, ``spm`` is S suffix P prefix M
middle, ``plain`` is the text itself (empty texts, texts that hold a marker, and
the share of rows beyond ``rate``).

Defined cases: a null text is an empty one; a null id is hashed as an empty
string; repeated rows get equal results; an empty table gives an empty table;
a column of the input named like a new one gives way to it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm._batches import table

#: A line with its end, or the last one without.
LINE = r"[^\n]*+\n|[^\n]++"
SEED, RATE, SPM_RATE = 7, 100, 50
MARKERS = ("<P>", "<S>", "<M>")
NEW = ("n", "form", "output", "prefix_chars", "middle_chars")


def _hashes(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = SEED,
                   rate: int = RATE, spm_rate: int = SPM_RATE, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``df`` with ``n`` (units), ``form``, ``output`` and the lengths of prefix
    and middle in code points (null where plain). ``unit``: a pattern of which
    each match takes what it can for good (possessive), without groups.
    ``markers``: strings that cannot overlap each other or text next to them
    (such as ``<P>``, whose first character occurs in it once)."""
    p, s, m = markers
    if any(set(x) & set("\\$") for x in markers) or len(set(markers)) < 3:
        raise ValueError("markers are three different strings without \\ and $")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in NEW]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    h1, h2, h3, h4 = _hashes(F.col(f"`{id_col}`"), seed)
    rows = df.select(*kept, text.alias("__text"), F.regexp_count(text, F.lit(unit)).cast("long").alias("n"),
                     *[h.alias(f"__h{i}") for i, h in enumerate((h1, h2, h3, h4), 1)])
    cut1, cut2 = F.pmod("__h1", F.col("n") + 1), F.pmod("__h2", F.col("n") + 1)
    a, c = F.least(cut1, cut2), F.abs(cut1 - cut2)
    marked = F.lit(False)
    for x in markers:
        marked = marked | F.contains(F.col("__text"), F.lit(x))
    plain = (F.col("__text") == "") | marked | (F.pmod("__h3", F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod("__h4", F.lit(100)) < spm_rate, "spm").otherwise("psm")
    pattern = F.concat(F.lit(rf"(?s)\A((?:{unit}){{"), a.cast("string"), F.lit(rf"}}+)((?:{unit}){{"), c.cast("string"), F.lit(r"}+)(.*)\z"))
    order = F.when(F.col("form") == "spm", F.lit(f"{s}$3{p}$1{m}$2")).otherwise(F.lit(f"{p}$1{s}$3{m}$2"))
    cut = rows.withColumn("form", form).withColumn("__pattern", pattern)
    out = cut.withColumn("output", F.when(F.col("form") == "plain", F.col("__text"))
                         .otherwise(F.regexp_replace("__text", F.col("__pattern"), order)))
    parts = _parts(F.col("output"), markers)
    prefix = F.when(F.col("form") == "spm", F.get(parts, F.lit(2))).when(F.col("form") == "psm", F.get(parts, F.lit(1)))
    middle = F.when(F.col("form") != "plain", F.get(parts, F.lit(3)))
    return out.select(*kept, "n", "form", "output", F.char_length(prefix).cast("long").alias("prefix_chars"),
                      F.char_length(middle).cast("long").alias("middle_chars"))


def _parts(output: Column, markers: tuple[str, str, str]) -> Column:
    """What stands before, between and after the three markers."""
    return F.split(output, "|".join(map(re.escape, markers)), -1)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text from its output and form."""
    parts = _parts(output, markers)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return (F.when(form == "plain", output).when(form == "spm", F.concat(second, middle, first))
            .otherwise(F.concat(first, middle, second)))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """One row per document with digests of the output and of the text rebuilt from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                      digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
  CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
f AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM f"""
