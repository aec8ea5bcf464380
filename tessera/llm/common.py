"""Helpers shared by the text operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: Word separators of every contract: space and the controls 0x09 to 0x0D.
SEPARATORS = " \t\n\x0b\f\r"
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"
#: Rows go to Python in batches of at most so many bytes (or one row), however long the texts are.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch sent to a Python worker, where the session sets no bound itself."""
    if not spark.conf.get(BATCH_SETTING, None):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more, and the shuffle files of finished steps.

    Spark deletes a shuffle's files when the driver collects the objects that stand for it. A
    driver with memory to spare does so rarely, and a chain of large steps would fill the
    disks meanwhile; so both collectors are asked here. Nothing depends on that they obey.
    """
    for df in frames:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
    gc.collect()
    frames[0].sparkSession.sparkContext._jvm.System.gc()


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once per row however often use() refers to it."""
    return F.transform(F.array(value), use)[0]


def numbers(values: list, kind: str) -> Column:
    """An array literal: one folded expression, however many values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column], F.lit(""))


SPANS = "array<struct<start:int,end:int,kind:string,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def running(values: Column, combine) -> Column:
    """values, each combined with all before it; n log n steps, whatever the length."""
    widths = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.size(values) - 1, F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    double = lambda own, w: F.transform(own, lambda x, i: F.when(i >= w, combine(F.get(own, i - w), x)).otherwise(x))
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(widths, values, double))


def match_spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start,end,kind,value>> of the leftmost non-overlapping matches of pattern.

    Code points, end exclusive. keep: a predicate on the matched string; failing matches
    are dropped after matching. Texts without a match cost one regex scan; many matches cost
    n log n.
    """

    def spans(parts):
        # the gaps between matches and the matches, in text order
        steps = F.transform(parts["found"], lambda hit, i: F.length(F.get(parts["gaps"], i)) + F.length(hit))
        placed = lambda ends: F.transform(
            parts["found"],
            lambda hit, i: F.struct((F.get(ends, i) - F.length(hit)).alias("start"), F.get(ends, i).alias("end"), F.lit(kind).alias("kind"), hit.alias("value")),
        )
        every = let(running(steps, lambda a, b: a + b), placed)
        return every if keep is None else F.filter(every, lambda s: keep(s["value"]))

    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
    )
    return F.when(text.rlike(pattern), let(found, spans)).otherwise(no_spans())


BLOCK = 4096


def replaced(text: Column, spans: Column, mark) -> Column:
    """text with every stretch that spans (sorted by start) cover replaced by mark(its first span).

    The text is cut into blocks once, so that a cut anywhere costs no scan from its start.
    """

    def rebuilt(blocks, ends):
        def cut(a, b):  # text[a:b]
            first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
            within = F.substring(F.get(blocks, first), a % BLOCK + 1, b - a)
            over = F.concat(
                F.substring(F.get(blocks, first), a % BLOCK + 1, F.lit(BLOCK)),
                F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                F.coalesce(F.substring(F.get(blocks, last), F.lit(1), b % BLOCK), F.lit("")),
            )
            return F.when(b <= a, F.lit("")).when(first == last, within).otherwise(over)

        piece = lambda s, i: let(
            F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)),
            lambda at: F.when(s["start"] >= at, F.concat(cut(at, s["start"]), mark(s))).otherwise(F.lit("")),
        )
        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(F.get(ends, F.size(ends) - 1), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(let(F.struct(blocks.alias("blocks"), ends.alias("ends")), lambda x: rebuilt(x["blocks"], x["ends"])))


def ordered_spans(spans: Column, kinds: list[str]) -> Column:
    """Spans by start, then by the place of their kind in kinds."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")),
    )
    return F.sort_array(keyed)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
