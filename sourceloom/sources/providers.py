"""Providers as plug-ins of a search plan, and the data source that serves their recorded answers.

A provider is an entry of REGISTRY: what it is called, what it needs to run, which answers it can read, and how they become rows.
`spark.read.format("provider_answers").option("provider", name).load(path)` gives its answers, one row a request; a plan names
providers, and `collect` reads, judges and parses what each of them answered. Parsing stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.ingest import top_per_site
from .feeds import feed_items, kb_entities, search_results
from .lookups import error_kind, failure_text, feed_outcome

#: Items of a site in a search, statuses of a used-up plan, longest feed in characters.
PER_SITE, QUOTA, FEED_CHARS = 6, (432, 433), 3_000_000
#: A recorded answer: the request, which of its parts it is (a site of a feed search, a batch of entities), and what came back.
#: error is null where an answer came, else timeout or network.
ANSWER = "research_id string, search_no int, provider string, query string, type string, part int, part_name string, status int, error string, body string"
CANDIDATE = ("research_id", "search_no", "provider", "query", "pos", "url", "title", "publisher", "published_at", "snippet", "type", "score")


@dataclass(frozen=True)
class Provider:
    """readable tells which bodies are of the expected shape; parse turns readable answers into rows, their order in pos."""

    name: str
    label: str
    supports: tuple[str, ...]
    readable: Callable[[Column], Column]
    parse: Callable[[DataFrame], DataFrame]
    #: Setting without which it can't run; none for those that need no key.
    needs: str | None = None
    quota: tuple[int, ...] = ()
    #: Whether a search asks several parts: some of them may fail without the search, and max_results cuts what they give together.
    fan_out: bool = False
    #: Whether parse gives candidates; others give rows of their own.
    candidates: bool = True

    def is_configured(self, settings: dict[str, str]) -> bool:
        return self.needs is None or bool(settings.get(self.needs))


REGISTRY: dict[str, Provider] = {}


def register(provider: Provider) -> Provider:
    """Add a provider; a plan can name it from then on."""
    REGISTRY[provider.name] = provider
    return provider


def parse_search(answers: DataFrame) -> DataFrame:
    rows = search_results(answers.withColumnRenamed("body", "response"))
    return rows.withColumn("published_at", F.try_to_timestamp("published_at")).select(*CANDIDATE)


def parse_feeds(answers: DataFrame) -> DataFrame:
    """The first items of each site, sites in order."""
    items = top_per_site(feed_items(answers, "body"), PER_SITE, ("research_id", "search_no", "part"))
    place = F.row_number().over(Window.partitionBy("research_id", "search_no").orderBy("part", "pos")) - 1
    return items.withColumns({"pos": place, "publisher": F.col("part_name"), "score": F.lit(None).cast("double")}).select(*CANDIDATE)


def is_search(body: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(body), "$.results", "array<variant>").isNotNull()


def is_feed(body: Column) -> Column:
    return body.rlike(r"<rss[\s>][\s\S]*<channel[\s>]") & (F.length(body) <= FEED_CHARS)


def is_entities(body: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(body), "$.entities", "variant").isNotNull()


register(Provider("web", "Web search", ("web", "news"), is_search, parse_search, needs="SEARCH_KEY", quota=QUOTA))
register(Provider("feeds", "News site search", ("news",), is_feed, parse_feeds, fan_out=True))
register(Provider("kb", "Knowledge base", (), is_entities, lambda answers: kb_entities(answers, "body"), candidates=False))


@dataclass
class Stretch(InputPartition):
    """Row groups of a file."""

    path: str
    groups: tuple[int, ...]


class AnswersReader(DataSourceReader):
    def __init__(self, path: str, provider: str | None, names: list[str], split_bytes: int) -> None:
        self.path, self.names, self.split_bytes = path, names, split_bytes
        self.equal: list[tuple[str, tuple]] = [("provider", (provider,))] if provider else []

    def opened(self):
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", self.path))
        test = reduce(lambda a, b: a & b, [ds.field(c).isin(list(v)) for c, v in self.equal], ds.scalar(True))
        return ds, files, at, test

    def partitions(self) -> list[Stretch]:
        ds, files, at, test = self.opened()
        out = []
        for f in ds.dataset(at, filesystem=files, format="parquet").get_fragments(test):
            held: list[int] = []
            size = 0
            for group in f.subset(test).row_groups:
                if held and size + group.total_byte_size > self.split_bytes:
                    out.append(Stretch(f.path, tuple(held)))
                    held, size = [], 0
                held.append(group.id)
                size += group.total_byte_size
            if held:
                out.append(Stretch(f.path, tuple(held)))
        return out

    def read(self, partition: Stretch | None):
        if partition is None:  # what Spark passes where there are no partitions
            return
        ds, files, _, test = self.opened()
        part = ds.ParquetFileFormat().make_fragment(partition.path, files, row_groups=list(partition.groups))
        for batch in part.to_batches(columns=self.names, filter=test, use_threads=False):
            if batch.num_rows:
                yield batch


class PruningReader(AnswersReader):
    """Used where spark.sql.python.filterPushdown.enabled is set; without it Spark refuses a reader that takes filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities of columns prune row groups by their statistics; Spark applies the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.names:
                self.equal.append((f.attribute[0], tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f


class AnswersSource(DataSource):
    """Recorded answers in Parquet files (columns ANSWER), those of the option `provider` or all.

    Options: split_bytes bounds what a task reads; pushdown = true lets equalities of columns prune row groups.
    """

    @classmethod
    def name(cls) -> str:
        return "provider_answers"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema) -> AnswersReader:
        kind = PruningReader if self.options.get("pushdown") == "true" else AnswersReader
        return kind(self.options["path"], self.options.get("provider"), schema.names, int(self.options.get("split_bytes", 32 << 20)))


def read_answers(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """The recorded answers of a registered provider."""
    if provider not in REGISTRY:
        raise KeyError(f"no provider is called {provider}; known: {', '.join(REGISTRY)}")
    spark.dataSource.register(AnswersSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(AnswersSource.name()).option("provider", provider).option("pushdown", pushdown).load(path)


def configured(spark: SparkSession, settings: dict[str, str]) -> DataFrame:
    """(provider, label) of the registered providers that can run."""
    return spark.createDataFrame([(p.name, p.label) for p in REGISTRY.values() if p.is_configured(settings)], "provider string, label string")


def judged(answers: DataFrame, provider: Provider) -> DataFrame:
    """answers with kind, null where the body can be read: as error_kind, or malformed."""
    kind = F.coalesce(error_kind(F.col("status"), F.col("error"), provider.quota), F.when(~F.coalesce(provider.readable(F.col("body")), F.lit(False)), "malformed"))
    return answers.withColumn("kind", kind)


def collect(spark: SparkSession, plan: DataFrame, path: str, settings: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(candidates, outcomes) of the plan's tasks (research_id, pos, provider, text, type, max_results) whose provider is registered and configured.

    candidates: CANDIDATE columns, at most max_results a task. outcomes: research_id, search_no, provider, failed, total, ok, warning a task that was
    answered: a search of several parts fails only where all do, others where any does.
    """
    asked = plan.select(F.col("research_id").cast("string").alias("research_id"), F.col("pos").cast("int").alias("search_no"), "provider", "max_results")
    candidates, outcomes = [], []
    for p in REGISTRY.values():
        if not (p.candidates and p.is_configured(settings)):
            continue
        own = asked.where(F.col("provider") == p.name).drop("provider")
        answers = judged(read_answers(spark, path, p.name).join(own, ["research_id", "search_no"]), p)
        # a task's number takes the place of the research's id where outcomes are summed by task
        parts = answers.select(F.struct("research_id", "search_no").alias("research_id"), F.coalesce("part_name", F.lit(p.label)).alias("name"), failure_text(F.col("kind"), F.col("status")).alias("reason"))
        sums = feed_outcome(parts).select("research_id.*", F.lit(p.name).alias("provider"), "failed", "total", "ok" if p.fan_out else (F.col("failed") == 0).alias("ok"), "warning")
        outcomes.append(sums)
        rows = p.parse(answers.where("kind IS NULL").drop("kind", "max_results"))
        candidates.append((rows.join(own, ["research_id", "search_no"]).where(F.col("pos") < F.col("max_results")) if p.fan_out else rows).select(*CANDIDATE))
    return reduce(DataFrame.unionByName, candidates), reduce(DataFrame.unionByName, outcomes)
