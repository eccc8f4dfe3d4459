"""Insert-if-absent that reads only the files whose filters may hold a key."""

from pyspark.sql import functions as F

from sourceloom.operators.store import insert_ignore
from sourceloom.sources.keyed import KeyedTable
from sourceloom.sources.versions import Store


def rows(spark, ids, note="first"):
    return spark.createDataFrame([(f"r{i % 7}" if i % 13 else None, f"https://x.org/{i}", note) for i in ids], "research_id string, canonical_url string, note string")


KEYS = ("research_id", "canonical_url")


def test_inserts_read_few_files(spark, tmp_path):
    box = Store(spark, f"file://{tmp_path}/store")
    table = KeyedTable(box, "sources", KEYS, partitions=4, slots=4)
    for k in range(6):
        assert table.insert_absent(rows(spark, range(100 * k, 100 * k + 100)))["added"] == 100
    before = table.read().count()
    new = table.insert_absent(rows(spark, range(5000, 5006)))  # a hundredth of the keys, all new
    assert new["files"] == 24 and new["read"] <= 2 and new["added"] == 6
    mixed = rows(spark, [*range(40, 43), *range(6000, 6003)], "second")
    some = table.insert_absent(mixed)
    assert some["added"] == 3 and 1 <= some["read"] <= 5 and some["files"] == 28
    again = table.insert_absent(rows(spark, range(300)))  # keys of three batches: their files, and hardly others
    assert again["added"] == 0 and 12 <= again["read"] <= 15
    assert table.read().count() == before + 9 and table.read().where("note = 'second'").count() == 3
    whole = insert_ignore(rows(spark, [*range(600), *range(5000, 5006)]), mixed)
    assert sorted(map(tuple, table.read().na.fill("-").collect())) == sorted(map(tuple, whole.na.fill("-").collect()))


def test_only_chosen_files_are_scanned(spark, tmp_path, monkeypatch):
    """By the plan: what is scanned for old keys are the files that the filters named."""
    box = Store(spark, f"file://{tmp_path}/store")
    table = KeyedTable(box, "sources", KEYS, partitions=4, slots=4)
    for k in range(4):
        table.insert_absent(rows(spark, range(50 * k, 50 * k + 50)))
    keyed = rows(spark, [60]).withColumns({"home": table._home(), "id": table._hash(-2)})
    chosen = table.files_for(keyed, box.read(table.filters))
    assert len(chosen) == 1
    scan = spark.read.parquet(*chosen)
    assert len(scan.inputFiles()) == 1 and scan.where("canonical_url = 'https://x.org/60'").count() == 1


def test_first_of_a_batch_and_another_writer(spark, tmp_path):
    box = Store(spark, f"file://{tmp_path}/store")
    table = KeyedTable(box, "sources", KEYS, partitions=2, slots=2)
    batch = rows(spark, [1], "b").unionByName(rows(spark, [1], "a")).unionByName(rows(spark, [0], "null key")).unionByName(rows(spark, [0], "null key"))
    assert table.insert_absent(batch, "note")["added"] == 2
    assert {r.canonical_url: r.note for r in table.read().collect()} == {"https://x.org/1": "a", "https://x.org/0": "null key"}

    class Busy(Store):
        def write(self, tables, partition_by=None):
            out = super().write(tables, partition_by)
            if partition_by and not told:
                told.append(1)
                table.insert_absent(rows(spark, [2, 3], "other"))
            return out

    told = []
    late = KeyedTable(Busy(spark, box.root), "sources", KEYS, partitions=2, slots=2)
    assert late.insert_absent(rows(spark, [3, 4], "late"))["added"] == 1  # 3 came meanwhile
    assert {r.canonical_url[-1]: r.note for r in table.read().collect()} == {"0": "null key", "1": "a", "2": "other", "3": "other", "4": "late"}
    assert late.insert_absent(rows(spark, [])) == {"files": box.read("sources_filters").select("file").distinct().count(), "read": 0, "added": 0}
