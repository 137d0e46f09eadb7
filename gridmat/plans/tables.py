"""The matrices that the registered queries build from the driver's tables.

All values but the revenues are whole numbers held as doubles, so sums are exact
in any order; revenues are for the sums that are exact for any numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmat.matrix import CellMatrix, VectorMatrix
from gridmat.operators.exact_sum import exact_sum
from gridmat.sources import from_table, from_vectors

HIGH_QUANTITY = 46
MONTHS = 12
FLAG_CODES = 128


class Tables:
    """Matrices over one folder of tables. Shapes come from the key columns."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._suppliers_parts: tuple[int, int] | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _shape(self) -> tuple[int, int]:
        """Suppliers and parts, from one job over the two key columns."""
        if self._suppliers_parts is None:
            keys = [
                self.read(table).select(F.lit(at).alias("at"), F.col(key).alias("key"))
                for at, (table, key) in enumerate(
                    [("supplier", "s_suppkey"), ("part", "p_partkey")]
                )
            ]
            both = keys[0].unionByName(keys[1]).groupBy("at").agg(F.max("key") + 1)
            self._suppliers_parts = tuple(n for _, n in sorted(both.collect()))
        return self._suppliers_parts

    def n_parts(self) -> int:
        return self._shape()[1]

    def embeddings(self) -> VectorMatrix:
        """E: vectors by id, dense."""
        table = self.read("embeddings")
        n, width = table.agg(F.max("vec_id") + 1, F.max(F.size("embedding"))).first()
        scaled = F.transform(
            "embedding", lambda x: F.floor(x.cast("double") * F.lit(1000.0)).cast("double")
        )
        return from_vectors(table, "vec_id", scaled, (n, width))

    def quantities(self) -> CellMatrix:
        """Q: quantity by supplier and part."""
        lines = self.read("lineitem")
        return from_table(lines, "l_suppkey", "l_partkey", "l_quantity", self._shape())

    def high_quantities(self) -> CellMatrix:
        """Qh: Q over large orders only; has empty columns."""
        lines = self.read("lineitem").filter(F.col("l_quantity") >= HIGH_QUANTITY)
        return from_table(lines, "l_suppkey", "l_partkey", "l_quantity", self._shape())

    def months(self) -> CellMatrix:
        """M: line count by part and month."""
        month = F.month("l_shipdate") - 1
        shape = (self.n_parts(), MONTHS)
        return from_table(self.read("lineitem"), "l_partkey", month, F.lit(1.0), shape)

    def months_from_one(self) -> CellMatrix:
        """N: M with the month's number as column; column 0 stays empty."""
        shape = (self.n_parts(), MONTHS + 1)
        return from_table(self.read("lineitem"), "l_partkey", F.month("l_shipdate"), F.lit(1.0), shape)

    def flags(self) -> CellMatrix:
        """R: quantity by supplier and return flag; three hot columns."""
        shape = (self._shape()[0], FLAG_CODES)
        return from_table(
            self.read("lineitem"), "l_suppkey", F.ascii("l_returnflag"), "l_quantity", shape
        )

    def discounts(self) -> CellMatrix:
        """D: discount in percent, less 5, by supplier and part; has zero cells."""
        percent = F.floor(F.col("l_discount") * F.lit(100.0) + F.lit(0.5)) - 5
        return from_table(self.read("lineitem"), "l_suppkey", "l_partkey", percent, self._shape())


    def revenue_lines(self) -> DataFrame:
        """Revenue of each line by supplier and part, ``(i, j, v)``; cells may come several times."""
        revenue = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
        lines = self.read("lineitem")
        return lines.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), revenue.alias("v"))

    def revenues(self) -> CellMatrix:
        """V: revenue by supplier and part, added exactly."""
        return CellMatrix.of(exact_sum(self.revenue_lines(), ["i", "j"]), *self._shape())


def exact_sql(value: str) -> str:
    """The double next to the true sum of values below 2**50 that are multiples of 2**-70, through whole numbers of 128 bits."""
    return f"cast(cast(sum(cast({value} * {2.0**70!r}::double as hugeint)) as varchar) as double) / {2.0**70!r}::double"


# The same matrices in SQL.
SQL = {
    "E": "select vec_id as i, cast(p - 1 as bigint) as j, floor(cast(x as double) * 1000) as v "
    "from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as p "
    "from embeddings)",
    "Q": "select l_suppkey as i, l_partkey as j, sum(l_quantity) as v from lineitem group by 1, 2",
    "H": "select l_suppkey as i, l_partkey as j, sum(l_quantity) as v from lineitem "
    f"where l_quantity >= {HIGH_QUANTITY} group by 1, 2",
    "M": "select l_partkey as i, cast(month(l_shipdate) - 1 as bigint) as j, "
    "cast(count(*) as double) as v from lineitem group by 1, 2",
    "N": "select l_partkey as i, cast(month(l_shipdate) as bigint) as j, "
    "cast(count(*) as double) as v from lineitem group by 1, 2",
    "R": "select l_suppkey as i, cast(ascii(l_returnflag) as bigint) as j, sum(l_quantity) as v "
    "from lineitem group by 1, 2",
    "V": f"select l_suppkey as i, l_partkey as j, {exact_sql('l_extendedprice * (1::double - l_discount)')} as v "
    "from lineitem group by 1, 2",
    "D": "select l_suppkey as i, l_partkey as j, "
    "sum(floor(l_discount * 100::double + 0.5::double) - 5) as v from lineitem group by 1, 2",
}


def with_matrices(names: str, query: str) -> str:
    """A query with the named matrices as common tables."""
    parts = ", ".join(f"{n} as ({SQL[n]})" for n in names)
    return f"with {parts} {query}"
