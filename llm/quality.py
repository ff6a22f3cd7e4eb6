"""Quality rules as a short-circuit cascade.

Each rule rejects a text by measures of it. The cost (seconds a megabyte) and
the selectivity (share rejected) of each rule are estimated on a bounded
sample; rules then run by rejection per cost, each only on the texts that all
earlier rules let through. The verdict is a conjunction, so the order changes
the time and never the verdict.

Measures over words (maximal runs of bytes outside x20, x09-x0D) and \\n-split
lines of the whole text; a null text has none. Windows of 8 words are compared
exactly, by ranks of words, then of pairs, fours and eights. Defined cases:
null and empty texts have 0 in every measure and fail ``too_short``; repeated
rows get the same verdict each; an empty table gives an empty table; columns of
the frame named like a result give way to it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm._batches import SPACE, Texts, add_columns, byte_table, pieces, sums_by_text, table, whole_row

SYMBOLS = byte_table(b"#*$%&|<>")
LINE_END = byte_table(b"\n")
WINDOW = 8
#: Rows and bytes of each that the cascade is planned on.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 20_000


class Measures:
    """Measures of several texts, each worked out when first asked for."""

    def __init__(self, texts: Texts, known: dict[str, np.ndarray] | None = None):
        self.texts, self._known = texts, dict(known or {})
        self._words = self._codes = None

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, f"_{name}")()
        return self._known[name]

    def take(self, rows: np.ndarray) -> "Measures":
        """The same for some of the texts (ascending indices)."""
        if len(rows) == len(self.texts):
            return self
        t, size = self.texts, np.diff(self.texts.offsets)
        mark = np.zeros(len(t), dtype=bool)
        mark[rows] = True
        data = t.data[np.repeat(mark, size)]
        offsets = np.concatenate([[0], np.cumsum(size[rows])]).astype(np.int64)
        return Measures(Texts(data, offsets), {k: v[rows] for k, v in self._known.items()})

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._words is None:
            self._words = self.texts.words(SPACE)
        return self._words

    def _count(self, flags: np.ndarray) -> np.ndarray:
        return sums_by_text(flags[self.texts.data], self.texts.offsets)

    def _n_words(self) -> np.ndarray:
        return np.diff(self.words()[2])

    def _word_chars(self) -> np.ndarray:
        lead = ~SPACE
        lead[0x80:0xC0] = False  # continuation bytes
        return self._count(lead)

    def _n_symbols(self) -> np.ndarray:
        return self._count(SYMBOLS)

    def _n_upper(self) -> np.ndarray:
        return self._count(byte_table(bytes(range(65, 91))))

    def _n_lower(self) -> np.ndarray:
        return self._count(byte_table(bytes(range(97, 123))))

    def _n_lines(self) -> np.ndarray:
        return self._lines()[2]

    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, first = self.texts.words(LINE_END)
        words = np.searchsorted(self.words()[0], np.stack([starts, ends]))
        full = words[1] > words[0]
        owner = np.repeat(np.arange(len(self.texts)), np.diff(first))[full]
        return starts[full], ends[full], np.bincount(owner, minlength=len(self.texts))

    def _n_dup_lines(self) -> np.ndarray:
        starts, ends, count = self._lines()
        if not len(starts):
            return np.zeros(len(self.texts), dtype=np.int64)
        owner = np.repeat(np.arange(len(self.texts)), count)
        code = pieces(self.texts.data, starts, ends).dictionary_encode().indices.to_numpy()
        again = pd.Series(owner * (int(code.max()) + 1) + code).duplicated().to_numpy()
        return np.bincount(owner[again], minlength=len(self.texts))

    def _n_repeat_words(self) -> np.ndarray:
        starts, ends, first = self.words()
        n = len(starts) - WINDOW + 1
        if n <= 0:
            return np.zeros(len(self.texts), dtype=np.int64)
        rank = pieces(self.texts.data, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64)
        step = 1
        while step < WINDOW:  # ranks of runs of 2, 4, 8 words
            rank = pd.factorize(rank[:-step] * (int(rank.max()) + 1) + rank[step:])[0].astype(np.int64)
            step *= 2
        owner = np.repeat(np.arange(len(self.texts)), np.diff(first))
        whole = owner[:n] == owner[WINDOW - 1:]
        key = np.where(whole, owner[:n] * (int(rank.max()) + 1) + rank, -1)
        found = whole & pd.Series(key).duplicated(keep=False).to_numpy()
        edge = np.zeros(len(starts) + 1, dtype=np.int32)
        edge[:n] += found
        edge[WINDOW:WINDOW + n] -= found
        return sums_by_text(np.cumsum(edge[:-1]) > 0, first)


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which ``rejects(measures)`` is true."""

    name: str
    rejects: Callable[[Measures], np.ndarray]


def too_short(m: Measures) -> np.ndarray:
    return m["n_words"] < 20


def repeats_itself(m: Measures) -> np.ndarray:
    return 100 * m["n_repeat_words"] > 30 * m["n_words"]


def symbol_heavy(m: Measures) -> np.ndarray:
    return 5 * m["n_symbols"] > m["n_words"]


def line_copies(m: Measures) -> np.ndarray:
    return 2 * m["n_dup_lines"] > m["n_lines"]


def shouting(m: Measures) -> np.ndarray:
    return m["n_upper"] > m["n_lower"]


def odd_word_length(m: Measures) -> np.ndarray:
    return (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])


BASE = [Rule("too_short", too_short), Rule("repeats_itself", repeats_itself)]
RULES = BASE + [Rule("symbol_heavy", symbol_heavy), Rule("line_copies", line_copies), Rule("shouting", shouting),
                Rule("odd_word_length", odd_word_length)]


def plan_cascade(sample: list[bytes], rules: list[Rule]) -> list[Rule]:
    """The rules by share rejected per second spent on the sample, best first.
    Each is timed on texts of which nothing has been measured."""
    data = Texts.of(pa.array(sample, type=pa.binary()))
    if not len(data):
        return list(rules)

    def worth(rule: Rule) -> float:
        began = time.process_time()
        rejected = int(rule.rejects(Measures(data)).sum())
        return (rejected + 0.5) / (len(data) + 1) / max(time.process_time() - began, 1e-6)

    return sorted(rules, key=lambda r: (-worth(r), r.name))


def run_cascade(measures: Measures, rules: list[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text passes all rules, and the index of the rule that
    rejected it (-1: none). A rule sees only what earlier rules let through."""
    by = np.full(len(measures.texts), -1)
    alive = np.arange(len(measures.texts))
    for i, rule in enumerate(rules):
        out = rule.rejects(measures)
        by[alive[out]] = i
        stay = np.flatnonzero(~out)
        alive, measures = alive[stay], measures.take(stay)
        if not len(alive):
            break
    return by < 0, by


def sample_texts(df: DataFrame, text_col: str) -> list[bytes]:
    """A bounded sample for planning only: at most SAMPLE_ROWS texts, SAMPLE_BYTES characters of each."""
    text = F.substring(F.col(f"`{text_col}`"), 1, SAMPLE_BYTES)
    rows = df.select(text.alias("t")).where("t is not null").sample(0.01, seed=7).limit(SAMPLE_ROWS).collect()
    rows = rows or df.select(text.alias("t")).where("t is not null").limit(SAMPLE_ROWS).collect()
    return [r.t.encode() for r in rows]


def apply_rules(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None,
                measures: tuple[str, ...] = (), keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``kept`` (all rules passed), ``rejected_by`` (the rule that
    rejected the text, in the order of the cascade; null if kept) and the named
    ``measures`` (each for every text, rejected or not)."""
    ordered = plan_cascade(sample_texts(df, text_col), RULES if rules is None else rules)
    names = np.array([r.name for r in ordered] + [None], dtype=object)

    def make():
        def work(column: pa.Array) -> list[pa.Array]:
            m = Measures(Texts.of(column))
            values = [pa.array(m[name].astype(np.int64)) for name in measures]
            kept, by = run_cascade(m, ordered)
            return values + [pa.array(kept), pa.array(names[by], type=pa.string())]
        return work

    fields = [T.StructField(x, T.LongType()) for x in measures]
    fields += [T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())]
    return add_columns(df, text_col, fields, make, keep)


DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op4_quality_cascade(spark, sf_dir: str) -> DataFrame:
    """One row per document: its measures, ``base_failed`` and ``kept``."""
    out = apply_rules(table(spark, sf_dir, "documents"), measures=DIGEST, keep=["doc_id"])
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", *DIGEST, base.alias("base_failed"), "kept")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass every rule."""
    rows = docs.select(whole_row(docs).alias("row"), F.col("text"))
    return apply_rules(rows, keep=["row"]).where("kept").select("row.*")


_W = "[^\\x20\\x09-\\x0D]"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}+') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '{_W}') GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.dup, 0) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(ln.n, 0) AS n_lines,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS low
      FROM w LEFT JOIN rep USING (r) LEFT JOIN ln USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR up > low
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m
"""
