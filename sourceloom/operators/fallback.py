"""Model calls with providers in order: who fails with one provider goes on to the next.

A provider fails for a request when the call does, when its answer is cut short, blocked or empty, or when the parser made for it rejects
the answer, well-formed or not. Each round asks one provider about the requests that are still open, so rounds shrink; what is
settled is written aside and never looked at again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..sources.lookups import error_kind
from ..sources.scratch import staged
from .analysis import ANALYSIS, CLASSIFICATION

#: What an answer's body holds, and what came of it.
READ = "struct<text:string,problem:string,input_tokens:bigint,output_tokens:bigint>"
FAILED = "array<struct<provider:string,model:string,error:string>>"


def _answer(text: Column, stop: Column, finish: str, blocked: Column, used: Column, made: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    problem = F.when(blocked.isNotNull(), F.concat(F.lit("prompt blocked ("), blocked, F.lit(")"))).when(
        stop != finish, F.concat(F.lit("generation stopped early ("), stop, F.lit(")"))).when(text == "", "empty response")
    return F.struct(text.alias("text"), problem.alias("problem"), used.cast("bigint").alias("input_tokens"), made.cast("bigint").alias("output_tokens"))


def _of(v: Column, path: str, kind: str = "string") -> Column:
    found = F.try_variant_get(v, path, kind)
    return F.nullif(found, F.lit("")) if kind == "string" else found


def parts_answer(body: Column) -> Column:
    """Answers whose text comes in parts of a first candidate."""

    def read(v: Column) -> Column:
        parts = F.coalesce(F.try_variant_get(v, "$.candidates[0].content.parts", "array<variant>"), F.array().cast("array<variant>"))
        text = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), "")
        return once(text, lambda x: _answer(x, _of(v, "$.candidates[0].finishReason"), "STOP", _of(v, "$.promptFeedback.blockReason"), _of(v, "$.usageMetadata.promptTokenCount", "bigint"), _of(v, "$.usageMetadata.candidatesTokenCount", "bigint")))

    return once(F.try_parse_json(body), read)


def choice_answer(body: Column) -> Column:
    """Answers whose text is the message of a first choice."""

    def read(v: Column) -> Column:
        return _answer(_of(v, "$.choices[0].message.content"), _of(v, "$.choices[0].finish_reason"), "stop", F.lit(None).cast("string"), _of(v, "$.usage.prompt_tokens", "bigint"), _of(v, "$.usage.completion_tokens", "bigint"))

    return once(F.try_parse_json(body), read)


@dataclass(frozen=True)
class Model:
    """A model of a provider: how its answers' bodies are read, the setting it needs, and how large a prompt may be."""

    provider: str
    model: str
    read: Callable[[Column], Column]
    max_input_tokens: int
    needs: str | None = None


#: The parser of a provider's answers: rows with text in, the same rows with value and problem out; one of the two is null.
Parse = Callable[[DataFrame], DataFrame]


def by_rule(value: Column, *problems: tuple[Column, str] | Column) -> Parse:
    """A parser from columns over text: the first problem whose condition holds, or that isn't null, rejects the answer. Problems may name the column value, which is read once."""
    what = F.coalesce(*[F.when(*p) if isinstance(p, tuple) else p for p in problems])

    def parse(answers: DataFrame) -> DataFrame:
        rows = answers.withColumn("value", value).withColumn("problem", what)
        return rows.withColumn("value", F.when(F.col("problem").isNull(), F.col("value")))

    return parse


def _shape(*problems: Callable[[Column], tuple[Column, str]]) -> Column:
    """What is wrong with the text as JSON, which is read once: null for an object without the further problems."""

    def wrong(json: Column) -> Column:
        found = F.when(json.isNull(), "output was not valid JSON").when(~F.schema_of_variant(json).startswith("OBJECT"), "output was not an object")
        for p in problems:
            found = found.when(*p(json))
        return found

    return once(F.try_parse_json("text"), wrong)


def analysis_parser() -> Parse:
    """Answers of the analysis: an object with an overview's summary."""
    return by_rule(F.from_json("text", ANALYSIS), _shape(), F.when(F.coalesce(F.trim("value.overview.summary"), F.lit("")) == "", "output had no overview summary"))


def relevance_parser(aliases: DataFrame, keys: tuple[str, ...], labels: tuple[str, ...]) -> Parse:
    """Answers of the classification: a list of sources of which one at least has a known alias and label. aliases: keys, alias."""
    shape = by_rule(F.from_json("text", CLASSIFICATION), _shape(lambda json: (F.try_variant_get(json, "$.sources", "array<variant>").isNull(), "output had no sources array")))

    def parse(answers: DataFrame) -> DataFrame:
        from .analysis import norm_alias

        rows = shape(answers)
        named = rows.select(*keys, F.explode("value.sources").alias("s")).where(F.col("s.label").isin(*labels)).select(*keys, norm_alias(F.col("s.id")).alias("alias"))
        usable = named.join(aliases, [*keys, "alias"], "left_semi").select(*keys).distinct().withColumn("usable", F.lit(True))
        rows = rows.join(usable, list(keys), "left")
        problem = F.coalesce("problem", F.when(F.col("usable").isNull(), "no usable classifications"))
        return rows.withColumn("problem", problem).withColumn("value", F.when(F.col("problem").isNull(), F.col("value"))).drop("usable")

    return parse


def generate(
    requests: DataFrame, models: list[Model], ask: Callable[[Model, DataFrame], DataFrame], prepare: Callable[[Model, DataFrame], tuple[DataFrame, Parse]], settings: dict[str, str],
    keys: tuple[str, ...] = ("research_id",),
) -> DataFrame:
    """(keys, value, provider, model, input_tokens, output_tokens, failed, error): a row a request, that of the first model whose answer holds.

    prepare gives a model's requests (the open rows, sized to its budget) and the parser of its answers; ask gives the answers (keys, status, error,
    body) to them, and a request without an answer counts as unreachable. Models that aren't configured are passed over. failed lists who was
    tried before; where nobody holds, value is null and error names every attempt. keys name a request once.
    """
    left = requests.withColumn("failed", F.array().cast(FAILED))
    done = []
    for m in models:
        if m.needs and not settings.get(m.needs):
            continue
        asked, parse = prepare(m, left)
        answers = ask(m, asked).select(*keys, F.col("status").cast("int").alias("status"), F.col("error").cast("string").alias("error"), "body")
        # dealt out before repeated answers go, so that they are sorted once
        answers = answers.repartition(*keys).dropDuplicates(list(keys))
        kind = F.when(F.col("there").isNull(), "network").otherwise(error_kind(F.col("status"), F.col("error")))
        got = left.join(answers.withColumn("there", F.lit(True)), list(keys), "left").withColumn("kind", kind)
        got = got.withColumn("a", F.when(F.col("kind").isNull(), m.read(F.col("body")))).withColumn("text", F.when(F.col("a.problem").isNull(), F.col("a.text")))
        got = parse(got)
        why = F.when(F.col("kind").isNotNull(), F.concat_ws(", HTTP ", "kind", F.when(F.col("error").isNull(), F.col("status")).cast("string")))
        why = why.when(F.col("a.problem").isNotNull(), F.concat(F.lit("malformed: "), F.col("a.problem"))).otherwise(F.col("problem"))
        # what later rounds and results read, not the answers' texts
        got = got.select(*left.columns, why.alias("why"), "value", "a.input_tokens", "a.output_tokens")
        got = staged(got.select(*left.columns, "why", F.when(F.col("why").isNull(), F.struct("value", "input_tokens", "output_tokens")).alias("got")), "attempts")
        done.append(got.where("why IS NULL").select(*keys, "got.value", F.lit(m.provider).alias("provider"), F.lit(m.model).alias("model"), "got.input_tokens", "got.output_tokens", "failed"))
        again = F.struct(F.lit(m.provider).alias("provider"), F.lit(m.model).alias("model"), F.col("why").alias("error"))
        left = got.where("why IS NOT NULL").withColumn("failed", F.concat("failed", F.array(again))).select(*left.columns)
        if left.isEmpty():
            break
    none = lambda kind: F.lit(None).cast(kind)
    value = done[0].schema["value"].dataType if done else "string"
    tried = F.array_join(F.transform("failed", lambda x: F.concat(x["provider"], F.lit(" ("), x["error"], F.lit(")"))), "; ")
    rest = left.select(*keys, none(value).alias("value"), none("string").alias("provider"), none("string").alias("model"), none("bigint").alias("input_tokens"), none("bigint").alias("output_tokens"), "failed")
    rest = rest.withColumn("error", F.concat(F.lit("All AI providers failed: "), tried))
    return reduce(DataFrame.unionByName, [d.withColumn("error", none("string")) for d in done], rest)
