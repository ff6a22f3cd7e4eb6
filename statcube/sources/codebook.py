"""Codebooks: per dataset, per column, a display name, an optional code list
(int code -> label), an optional weighted-average definition and the cube
layout role (``group_type``).

A code list is either small configuration (YAML, kept on the driver and
inlined as a literal map) or a lookup relation read from data (a DataFrame,
joined as a lookup: broadcast only when the planner's size check passes,
else by shuffle).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statcube.schema import AVG_PREFIX

# The region list used to derive REGION from a decoded COUNTY
# label in decoded cubes (both spellings of 臺/台 are listed).
REGION_COUNTIES = {
    "北部區域": ["臺北市", "台北市", "新北市", "基隆市", "新竹市", "桃園市", "新竹縣", "宜蘭縣"],
    "中部區域": ["臺中市", "台中市", "苗栗縣", "彰化縣", "南投縣", "雲林縣"],
    "南部區域": ["高雄市", "臺南市", "台南市", "嘉義市", "嘉義縣", "屏東縣", "澎湖縣"],
    "東部區域": ["花蓮縣", "臺東縣", "台東縣"],
    "福建省": ["金門縣", "連江縣"],
}

def load_codebook(path: str) -> dict:
    """Parse a YAML codebook file (configuration, read on the driver)."""
    import yaml

    with open(path, encoding="utf-8") as fh:
        return yaml.safe_load(fh) or {}


def codebook_section(codebook: Mapping, name: str) -> dict:
    """The columns that one section of a codebook describes."""
    section = codebook.get(name)
    if not isinstance(section, Mapping):
        raise LookupError(f"no section {name!r} among {sorted(map(str, codebook))}")
    return {**section}


@dataclass(frozen=True)
class AvgSpec:
    name: str
    num: str
    den: str


@dataclass
class Codebook:
    """One dataset section of a codebook plus data-derived code lists."""

    section: dict = field(default_factory=dict)
    lookups: dict[str, DataFrame] = field(default_factory=dict)   # column -> (code long, label string)
    derived: dict[str, str] = field(default_factory=dict)         # derived column -> parent column
    unique_codes: frozenset = frozenset()                         # lookups whose code is a key of the source

    # ---- configuration view -------------------------------------------------
    def entry(self, col: str) -> dict:
        e = self.section.get(col)
        return e if isinstance(e, dict) else {}

    def display_name(self, col: str) -> str:
        return self.entry(col).get("name", col)

    def display_names(self) -> dict[str, str]:
        return {c: self.display_name(c) for c, e in self.section.items() if isinstance(e, dict)}

    def static_codes(self, col: str) -> dict[int, str]:
        codes = self.entry(col).get("codes") or {}
        out = {}
        for k, v in codes.items():
            if isinstance(k, int) or str(k).isdigit():
                out[int(k)] = str(v)
        return out

    def has_codes(self, col: str) -> bool:
        return col in self.lookups or bool(self.static_codes(col))

    def avg_spec(self, col: str) -> AvgSpec | None:
        e = self.entry(col)
        cfg = e.get("avg")
        if not cfg:
            return None
        name = cfg.get("name", f"{AVG_PREFIX}{e.get('name', col)}")
        return AvgSpec(name=name, num=cfg["num"], den=cfg["den"])

    def group_types(self) -> dict[str, str]:
        return {c: e.get("group_type") for c, e in self.section.items() if isinstance(e, dict) and e.get("group_type")}

    # ---- relational view -----------------------------------------------------
    def with_lookup(self, col: str, df: DataFrame, code_col: str, label_col: str, unique: bool = False) -> Codebook:
        """Code list of ``col`` read from data. ``unique``: the code is a key of
        the source table, so no de-duplication pass is needed."""
        lk = df.select(F.col(code_col).cast("long").alias("code"), F.col(label_col).cast("string").alias("label"))
        uniq = self.unique_codes | {col} if unique else self.unique_codes - {col}
        return Codebook(dict(self.section), {**self.lookups, col: lk}, dict(self.derived), uniq)

    def with_derived(self, col: str, parent: str) -> Codebook:
        return Codebook(dict(self.section), dict(self.lookups), {**self.derived, col: parent}, self.unique_codes)

    def codes_frame(self, spark: SparkSession, col: str) -> DataFrame:
        """(code, label) of one column."""
        if col in self.lookups:
            return self.lookups[col]
        rows = [(int(k), v) for k, v in sorted(self.static_codes(col).items())]
        return spark.createDataFrame(rows, "code long, label string")

    def label_ranks(self, spark: SparkSession, col: str) -> DataFrame:
        """(label, rank): labels in the order of their codes; a label listed
        under several codes takes the last one's place. The code itself is the
        rank, so nothing has to be numbered."""
        return self.codes_frame(spark, col).groupBy("label").agg(F.max("code").alias("rank"))
