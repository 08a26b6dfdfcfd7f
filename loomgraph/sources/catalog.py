"""A folder of Parquet tables, one for each table of the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import key, strip


class Catalog:
    """Reads and replaces tables; a missing table is empty, missing columns are null."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        self._settle(name)
        path, fs = self._fs(self._path(name))
        return fs.exists(path)

    def _settle(self, name: str) -> None:
        """Ends a swap that was cut short between its renames: the complete new snapshot comes in, else the old one comes back."""
        path, fs = self._fs(self._path(name))
        if not fs.exists(path):
            for other, mark in (("new", "/_SUCCESS"), ("old", "")):
                if fs.exists(self._fs(f"{self._path(name)}.{other}{mark}")[0]):
                    fs.rename(self._fs(f"{self._path(name)}.{other}")[0], path)
                    return

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            return self.spark.createDataFrame([], S.TABLES[name])
        return S.conform(self.spark.read.option("mergeSchema", "true").parquet(self._path(name)), S.TABLES[name])

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes a new snapshot beside the old one and then swaps them, so readers never see half a table.

        A run that ends between the two renames leaves both snapshots; the next
        read or write ends the swap, so no table is lost or taken to be empty.
        """
        self._settle(name)
        new, old = f"{self._path(name)}.new", f"{self._path(name)}.old"
        S.conform(rows, S.TABLES[name]).write.mode("overwrite").parquet(new)
        (p_new, fs), (p_old, _), (p, _) = self._fs(new), self._fs(old), self._fs(self._path(name))
        fs.delete(p_old, True)
        if fs.exists(p):
            fs.rename(p, p_old)
        fs.rename(p_new, p)
        fs.delete(p_old, True)

    def append(self, name: str, rows: DataFrame) -> None:
        self._settle(name)
        S.conform(rows, S.TABLES[name]).write.mode("append").parquet(self._path(name))


def list_nodes(nodes: DataFrame, status: str | None = None) -> DataFrame:
    return (nodes if status is None else nodes.where(F.col("status") == status)).orderBy("id")


def list_edges(edges: DataFrame, status: str | None = None, edge_type: str | None = None) -> DataFrame:
    for column, value in (("status", status), ("type", edge_type)):
        edges = edges if value is None else edges.where(F.col(column) == value)
    return edges.orderBy("id")


def get_node(nodes: DataFrame, who: int | str) -> DataFrame:
    return nodes.where(F.col("id") == who) if isinstance(who, int) else nodes.where(F.col("name") == strip(F.lit(who)))


def get_page(pages: DataFrame, lang: str, title: str) -> DataFrame:
    return pages.where((F.col("lang") == lang) & (F.lower("title") == title.lower()))


def list_sections(sections: DataFrame, book: str | None = None, sec_id: str | None = None) -> DataFrame:
    for column, value in (("book", book), ("sec_id", sec_id)):
        sections = sections if value is None else sections.where(F.col(column) == value)
    return sections.orderBy("book", "ord")


def named(nodes: DataFrame, name: str) -> DataFrame:
    """The node that a name or alias means."""
    from ..operators.names import name_index

    found = name_index(nodes).where(F.col("key") == key(F.lit(name))).select(F.col("node_id").alias("id"))
    return nodes.join(found, "id", "left_semi")
