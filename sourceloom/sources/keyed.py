"""Insert-if-absent into a versioned table without reading all of it: old files are chosen by Bloom filters.

Rows lie in partitions by a hash of their keys. Each file has a filter, built by Spark's own bitmap functions when the file is written and kept as a table of the
same version: HASHES positions a key in slots of 32 768 bits. A batch looks its keys' positions up in the filters of their partitions by a join; a
file in which some key finds all of its positions is read, no other. Keys that are new, as most are, read next to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import staged
from .versions import Conflict, Store

HASHES, SLOT_BITS = 4, 32_768


class KeyedTable:
    """A table of a store in which each key occurs once.

    partitions: of the key's hash. slots: of a file's filter; a slot holds about 3000 keys at one false hit in a hundred.
    """

    def __init__(self, store: Store, table: str, keys: tuple[str, ...], partitions: int = 64, slots: int = 32) -> None:
        self.store, self.table, self.filters = store, table, f"{table}_filters"
        self.keys, self.partitions, self.slots = list(keys), partitions, slots

    def _hash(self, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *self.keys)

    def _home(self) -> Column:
        return F.pmod(self._hash(-1), F.lit(self.partitions)).cast("int")

    def _positions(self, rows: DataFrame, *columns: str | Column) -> DataFrame:
        """columns, slot and bit: HASHES rows a row."""
        every = F.array(*[F.struct(F.pmod(self._hash(2 * i), F.lit(self.slots)).alias("slot"), F.pmod(self._hash(2 * i + 1), F.lit(SLOT_BITS)).alias("bit")) for i in range(HASHES)])
        return rows.select(*columns, F.explode(every).alias("p")).select(*[c for c in rows.select(*columns).columns], "p.slot", "p.bit")

    def _filters_of(self, segment: str) -> DataFrame:
        """(file, home, slot, bits) of a segment's files."""
        rows = self.store.spark.read.parquet(f"{self.store.root}/{segment}")
        at = self._positions(rows, F.col("_metadata.file_path").alias("file"), self._home().alias("home"))
        return at.groupBy("file", "home", "slot").agg(F.bitmap_construct_agg("bit").alias("bits"))

    def files_for(self, keyed: DataFrame, filters: DataFrame) -> list[str]:
        """The files that may hold a key of keyed (keys, home, id): at most all files, names alone."""
        asked = self._positions(keyed, "id", "home")
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
        found = asked.join(filters, ["home", "slot"]).where(hit).groupBy("id", "file").agg(F.count(F.lit(1)).alias("n"))
        return sorted(r.file for r in found.where(F.col("n") == HASHES).select("file").distinct().collect())

    def insert_absent(self, rows: DataFrame, order: str | None = None, tries: int = 20) -> dict[str, int]:
        """Add the rows whose keys the table doesn't have; of several with one key the first by order. Returns files (there are), read, added.

        Null keys are keys like others. Where another writer publishes first, the rows are held against what it left.
        """
        one = rows.groupBy(*self.keys).agg((F.min_by if order else F.any_value)(F.struct(*rows.columns), *([F.col(order)] if order else [])).alias("r")).select("r.*")
        new = staged(one.withColumns({"home": self._home(), "id": self._hash(-2)}), "new-rows")
        for _ in range(tries):
            base = self.store.last()
            absent, files, read = new, 0, 0
            if self.store.has(self.table, base):
                filters = self.store.read(self.filters, base)
                files = filters.select("file").distinct().count()
                chosen = self.files_for(new, filters)
                read = len(chosen)
                if chosen:
                    old = self.store.spark.read.parquet(*chosen).select(*[F.col(k).alias(f"old_{k}") for k in self.keys])
                    same = [F.equal_null(F.col(k), F.col(f"old_{k}")) for k in self.keys]
                    absent = new.join(old, same, "left_anti")
            absent = staged(absent, "absent")
            added = absent.count()
            if not added:
                return {"files": files, "read": read, "added": 0}
            dealt = absent.drop("id").repartition("home").withColumnRenamed("home", "__home")
            segment = self.store.write({self.table: dealt}, {self.table: "__home"})[self.table]
            kept = self.store.write({self.filters: self._filters_of(segment)})[self.filters]
            now = base.tables
            try:
                self.store.publish(base, now | {self.table: [*now.get(self.table, []), segment], self.filters: [*now.get(self.filters, []), kept]})
            except Conflict:
                continue
            return {"files": files, "read": read, "added": added}
        raise Conflict(f"no version of its own in {tries} tries")

    def read(self) -> DataFrame:
        return self.store.read(self.table).drop("__home")
