"""The order-statistics cube: a statistical cube built from the TPC-H style
tables, in the shape of a delivered cube.

Dimensions (schema order): DATA_YR (order year, fixed), COUNTY (customer
nation code, rollup), SEG (market segment) and PRI (order priority) as a
grouping set; metrics CNT (orders), SUM_PRICE (total price in cents),
CNT_PRICE (orders with a price); GID; DATA_STATUS (suppressed when CNT < 3).
Decoding turns the COUNTY code into the nation name (code list = nation
table) and derives REGION through nation -> region.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statcube.operators.cube import CubeLayout, build_cube, flag_suppressed, layout_of
from statcube.operators.decode import decode_cube
from statcube.session import cut_lineage
from statcube.sources.codebook import Codebook, codebook_section, load_codebook
from statcube.sources.tables import read_table

CONFIG = os.path.join(os.path.dirname(os.path.dirname(__file__)), "config", "orders_cube.yaml")
DATASET = "orders"


@lru_cache(maxsize=1)
def _section() -> dict:
    return codebook_section(load_codebook(CONFIG), DATASET)


def microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows with their customer's nation and segment. The planner picks
    the join from the tables' sizes, and AQE splits skewed partitions."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.year("o_orderdate").cast("long").alias("DATA_YR"),
        F.col("o_orderpriority").alias("PRI"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("COUNTY"), F.col("c_mktsegment").alias("SEG"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")


def build(rows: DataFrame) -> DataFrame:
    """Cube cells of order rows, laid out as the codebook says."""
    lay = layout_of(Codebook(_section()).group_types())
    return build_cube(rows, lay["fixed"], lay["rollup"], lay["grouping"],
                      {"CNT": F.count(F.lit(1)), "SUM_PRICE": F.sum("cents"), "CNT_PRICE": F.count("cents")})


def coded_cube(spark: SparkSession, sf_dir: str, suppress: bool = True) -> DataFrame:
    cube = build(microdata(spark, sf_dir))
    return flag_suppressed(cube) if suppress else cube


def layout() -> CubeLayout:
    lay = layout_of(Codebook(_section()).group_types())
    return CubeLayout(tuple(lay["fixed"]), tuple(lay["rollup"]), tuple(lay["grouping"]), {"REGION": "COUNTY"})


def cube_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube of rows of which some lack a dimension (every seventh order has
    no priority, every eleventh customer no segment, nation 3 is unknown) and
    some hold values that look like a lack (nation -1, segment '(missing)')."""
    rows = microdata(spark, sf_dir)
    key = F.col("c_custkey")
    return build(rows.withColumns({
        "PRI": F.when(F.col("cents") % 7 != 0, F.col("PRI")),
        "SEG": F.when(key % 13 == 0, F.lit("(missing)")).when(key % 11 != 0, F.col("SEG")),
        "COUNTY": F.when(F.col("COUNTY") == 4, F.lit(-1)).when(F.col("COUNTY") != 3, F.col("COUNTY"))}))


def codebook(spark: SparkSession, sf_dir: str) -> Codebook:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return (Codebook(_section())
            .with_lookup("COUNTY", nation, "n_nationkey", "n_name", unique=True)
            .with_lookup("REGION", region, "r_regionkey", "r_name", unique=True)
            .with_derived("REGION", "COUNTY"))


def region_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(county label, region label) from nation -> region."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("county"), F.col("r_name").alias("region"))


def decoded_cube(spark: SparkSession, sf_dir: str, materialize: bool = False) -> DataFrame:
    """Decoded cube; ``materialize`` writes it once to the shared checkpoint
    folder so the several passes of a crosstab read it instead of rebuilding
    it from the order rows."""
    # nation names are unique per nation, so county -> region needs no de-duplication
    cube = decode_cube(coded_cube(spark, sf_dir), codebook(spark, sf_dir), region_map(spark, sf_dir),
                       unique_regions=True)
    return cut_lineage(cube) if materialize else cube
