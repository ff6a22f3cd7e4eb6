"""Decode coded dimensions to labels and derive REGION from COUNTY.

Small code lists are inlined as literal maps (no join at all); code lists read
from data are joined as lookups: broadcast when the planner's size check
passes (autoBroadcastJoinThreshold, re-checked by AQE at runtime), otherwise
by shuffle. Unmapped codes pass through as their string form; NULL (subtotal)
stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statcube.schema import UNMAPPED_REGION
from statcube.sources.codebook import REGION_COUNTIES, Codebook


def _integral_key(c: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """(lookup key as long, string form for unmapped values)."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        key = c.cast("long")
        return key, key.cast("string")
    # floating / decimal: only whole numbers can match an integer code
    whole = c == F.floor(c)
    key = F.when(whole, c.cast("long"))
    return key, F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def decode(df: DataFrame, codebook: Codebook) -> DataFrame:
    """Replace codes by labels in every column that has a code list."""
    out = df
    select = {}
    for field in df.schema.fields:
        c, dtype = field.name, field.dataType
        if not codebook.has_codes(c) or not isinstance(dtype, T.NumericType):
            continue  # text columns already carry labels
        key, raw = _integral_key(F.col(c), dtype)
        if c in codebook.lookups:
            k, lab = f"__code_{c}", f"__label_{c}"
            codes_df = codebook.lookups[c].select(F.col("code").alias(k), F.col("label").alias(lab))
            if c not in codebook.unique_codes:
                # one label per code: duplicated codes in a lookup would multiply rows
                codes_df = codes_df.groupBy(k).agg(F.max(lab).alias(lab))
            out = out.join(codes_df, key == F.col(k), "left")
            select[c] = F.when(F.col(c).isNotNull(), F.coalesce(F.col(lab), raw)).alias(c)
        else:
            codes = codebook.static_codes(c)
            m = F.create_map(*[x for k, v in sorted(codes.items()) for x in (F.lit(k).cast("long"), F.lit(v))])
            select[c] = F.when(F.col(c).isNotNull(), F.coalesce(F.try_element_at(m, key), raw)).alias(c)
    if not select:
        return df
    return out.select(*[select.get(c, F.col(c)) for c in df.columns])


def derive_region(df: DataFrame, county: str = "COUNTY", out: str = "REGION",
                  mapping: DataFrame | dict | None = None, unique: bool = False) -> DataFrame:
    """Append ``out`` = region of the decoded county label.

    ``mapping`` is a (county, region) relation or a region -> counties dict
    (default: the delivery region list). A non-null county no region lists
    gets the 'unclassified region' label; a NULL county (subtotal) stays NULL.
    """
    mapping = REGION_COUNTIES if mapping is None else mapping
    county_str = F.col(county).cast("string")
    if isinstance(mapping, dict):
        pairs = [(c, r) for r, cs in mapping.items() for c in cs]
        m = F.create_map(*[x for c, r in pairs for x in (F.lit(c), F.lit(r))])
        mapped = F.try_element_at(m, county_str)
        base = df
    else:
        lk = mapping.select(F.col("county").cast("string").alias("__county"), F.col("region").alias("__region"))
        if not unique:  # one region per county
            lk = lk.groupBy("__county").agg(F.max("__region").alias("__region"))
        base = df.join(lk, county_str == F.col("__county"), "left")
        mapped = F.col("__region")
    region = (F.when(F.col(county).isNull(), F.lit(None).cast("string"))
              .when(mapped.isNull(), F.lit(UNMAPPED_REGION))
              .otherwise(mapped))
    return base.select(*[F.col(c) for c in df.columns if c != out], region.alias(out))


def unmapped_counties(df: DataFrame, county: str = "COUNTY", out: str = "REGION",
                      mapping: DataFrame | dict | None = None) -> DataFrame:
    """Distinct non-null counties that no region lists (the warning list)."""
    with_region = derive_region(df.select(county), county, out, mapping)
    return (with_region.where(F.col(county).isNotNull() & (F.col(out) == UNMAPPED_REGION))
            .select(F.col(county).cast("string").alias(county)).distinct())


def decode_cube(df: DataFrame, codebook: Codebook, region_mapping: DataFrame | dict | None = None,
                unique_regions: bool = False) -> DataFrame:
    """Decode, then append each derived column (REGION from COUNTY) last."""
    out = decode(df, codebook)
    for derived, parent in codebook.derived.items():
        if parent in out.columns and derived not in df.columns:
            out = derive_region(out, parent, derived, region_mapping, unique_regions)
    return out


def rename_for_display(df: DataFrame, codebook: Codebook) -> DataFrame:
    names = {c: n for c, n in codebook.display_names().items() if c in df.columns and n != c}
    return df.withColumnsRenamed(names) if names else df
