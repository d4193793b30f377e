"""The given star-schema tables seen as survey microdata.

A line item is one record of a household (its order) in one implicate; the customer's region is the
country, the nation is the region within it. The tables hold no missing values, so NULLs and zeros
are set by arithmetic on the keys. Unless all countries are asked for, the filter on them comes first: it
reduces customers and orders before the large table is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

COUNTRIES = ["AT", "DE"]
REPLICATES = 100

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}

# Nation -> region code; the two X codes have no name in the region list.
REGION_CODES = {
    "NATION_2": "AT11", "NATION_7": "AT12", "NATION_12": "AT13", "NATION_17": "AT21", "NATION_22": "ATXX",
    "NATION_3": "DENW", "NATION_8": "DEWW", "NATION_13": "DEOS", "NATION_18": "DESW", "NATION_23": "DEXX",
}


def _unless(k: int, key: str, value: str) -> str:
    """The value, missing where the key is a multiple of k."""
    return f"CASE WHEN {key} % {k} <> 0 THEN {value} END"


_CODES = ", ".join(f"'{n}', '{c}'" for n, c in REGION_CODES.items())

COLUMNS = {
    "id": "l_orderkey",
    "person_no": "l_linenumber",
    "im0100": "1 + l_suppkey % 5",
    "sa0100": "CASE r_name WHEN 'ASIA' THEN 'AT' WHEN 'EUROPE' THEN 'DE' ELSE r_name END",
    "dhregion": f"map({_CODES})[n_name]",
    "hw0010": "l_quantity",
    "hb0800": f"CASE WHEN l_orderkey % 97 = 0 THEN 0D ELSE {_unless(13, 'l_orderkey', 'p_retailprice * 25')} END",
    "hb0900": _unless(13, "l_orderkey", "l_extendedprice"),
    "hb0700": _unless(11, "l_orderkey", "1960 + 9 * (year(o_orderdate) - 1995)"),
    "hb0100": _unless(31, "l_partkey", "double(p_size)"),
    "netliquidassets": "c_acctbal",
    "networth": "o_totalprice",
    "dnnlaratio": "try_divide(c_acctbal, l_extendedprice)",
    "agerefperson": "18 + c_custkey % 68",
    "edurefperson": "int(substring(o_orderpriority, 1, 1))",
    "dhgenderh1": "1 + c_custkey % 2",
    "age": _unless(19, "l_partkey", "18 + l_partkey % 70"),
    "ra0200": _unless(29, "l_partkey", "1 + l_suppkey % 2"),
    "pa0100": _unless(23, "l_partkey", "1 + l_partkey % 5"),
    "pa0200": _unless(17, "l_partkey", "l_suppkey % 7"),
    "pe0100a": _unless(37, "l_partkey", "1 + l_linenumber % 3"),
    "dh0001": "double(l_linenumber)",
    "dh0006": _unless(21, "l_partkey", "double(l_linenumber) - (l_orderkey % 4 - 1)"),
    "di1100": _unless(3, "l_partkey", "l_extendedprice * l_tax"),
    "di1200": _unless(6, "l_partkey", "l_extendedprice * l_tax * 0.5D"),
    "di1300": _unless(10, "l_partkey", "l_quantity * l_tax * 100"),
    "di1400": _unless(12, "l_partkey", "c_acctbal * 0.02D"),
    "di1420": _unless(2, "l_partkey", "l_discount * 1000"),
    "di1500": _unless(5, "l_partkey", "l_extendedprice * 0.05D"),
    "di1600": _unless(4, "l_partkey", "l_extendedprice * l_discount"),
    "di1700": _unless(15, "l_partkey", "l_quantity * 10"),
    "di2000": "l_extendedprice * (1 + l_tax)",
    "da2101": _unless(8, "l_partkey", "c_acctbal * 1.5D + l_quantity"),
    "docogood": "l_extendedprice * (1 - l_discount)",
    "docogoodp": _unless(41, "l_partkey", "try_divide(l_extendedprice * (1 - l_discount), o_totalprice)"),
    "dofoodc": "l_extendedprice * l_tax * 0.25D",
    "hi0210": "l_quantity * 30",
}

_PART_COLUMNS = {"hb0800", "hb0100"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def house(spark: SparkSession, sf_dir: str, cols: Sequence[str], countries: Sequence[str] | None = COUNTRIES) -> DataFrame:
    """The listed survey columns, one row per record of the countries; of all countries if there are none."""

    def t(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    def join(left: DataFrame, right: DataFrame, key: str, ref: str) -> DataFrame:
        return left.join(right, left[key] == right[ref])

    region = t("region")
    if countries is not None:
        region = region.where(F.expr(COLUMNS["sa0100"]).isin(*countries))
    nation = join(t("nation"), region, "n_regionkey", "r_regionkey")
    customer = join(t("customer"), nation, "c_nationkey", "n_nationkey")
    orders = join(t("orders"), customer, "o_custkey", "c_custkey")
    rows = join(t("lineitem"), orders, "l_orderkey", "o_orderkey")
    if _PART_COLUMNS & set(cols):
        rows = join(rows, t("part"), "l_partkey", "p_partkey")
    return rows.selectExpr(*[f"{COLUMNS[c]} AS {c}" for c in cols])


def replicate_vectors(spark: SparkSession, sf_dir: str, replicates: int = REPLICATES) -> DataFrame:
    """The weight table: one row per household with its replicate factors as an array."""
    factor = "double(1 + (o_orderkey * r + o_custkey) % 3) / 2"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"transform(sequence(1, {replicates}), r -> {factor}) AS replicates")
