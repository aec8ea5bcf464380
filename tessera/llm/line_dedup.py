"""Lines found in many documents, dropped from all of them.

The hashes of line keys are range-partitioned and sorted within a range by document and
position. One stream over a range sees the first line of each document with a key, counts
documents by these, and marks the lines of keys in enough documents. What goes back to a
document is a bitmap of the lines it keeps, never text: words of 64 lines, and only those
words that lose a line.

A key that a large share of all rows hold would fill one range. Such keys are found before:
a key that stands in min_documents documents of a bounded sample of the lines is certainly in
so many of all, so its lines are marked at once, where they lie, by a broadcast of at most
SAMPLE / min_documents keys. All other keys are counted whole. Built-in expressions only.

Defined results: a row is a document, also where rows or ids repeat; a null text is empty; an
empty text is one empty line; an empty table gives an empty table; a null id is an id like
others; keys shorter than min_characters are never dropped; columns of the caller pass
through, whatever their names (those named like results are replaced). The lines of one text
are held as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SEPARATORS, let, stored, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters beyond A-Z that have a lower case, or may have one in a newer Unicode than the JVM's.
OTHER_UPPER = r"[\x{80}-\x{10FFFF}&&[\p{javaUpperCase}\p{Lt}\p{Cn}]]"
#: Lines among which keys of very many documents are looked for.
SAMPLE = 1_000_000
#: Lines to a word of a bitmap.
WORD = 64


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without separators at its ends, A-Z in lower case."""
    # translate goes by character, lower does the same much faster where no other letter has a lower case
    lowered = lambda key: F.when(key.rlike(OTHER_UPPER), F.translate(key, UPPER, LOWER)).otherwise(F.lower(key))
    return let(F.btrim(line, F.lit(SEPARATORS)), lowered)


def keyed_lines(df: DataFrame, id_column: str, text_column: str, min_characters: int) -> DataFrame:
    """h1, h2 (the hash of the key), row, pos, doc and text_hash of each line with a key, stored."""
    text = text_of(df, text_column)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc"), F.xxhash64(text).alias("text_hash"), F.transform(lines_of(text), line_key).alias("keys"))
    keyed = rows.select("row", "doc", "text_hash", F.posexplode("keys").alias("pos", "key")).where(F.length("key") >= max(min_characters, 1))
    return stored(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "row", "pos", "doc", "text_hash"), "line-keys")


def keep_bitmaps(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_documents: int = 10, min_characters: int = 1) -> DataFrame:
    """doc, text_hash and words for documents that lose lines: array<struct<word,kept>>, a bit of kept for each of 64 lines.

    Lines 64 * word to 64 * word + 63 of the document; words that are not listed keep all.
    """
    lines = keyed_lines(df, id_column, text_column, min_characters)
    share = SAMPLE / max(lines.count(), SAMPLE)
    sampled = lines if share == 1 else lines.sample(share, seed=7)
    seen = sampled.groupBy("h1", "h2", "row").agg(F.lit(1).alias("first")).groupBy("h1", "h2").count()
    hot = stored(seen.where(F.col("count") >= min_documents).select("h1", "h2"), "hot-lines")
    found = lines.join(F.broadcast(hot), ["h1", "h2"], "left_semi")
    marked = found.select("doc", "text_hash", "pos")
    if share < 1:
        rest = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2")
        of_document = Window.partitionBy("h1", "h2", "row").orderBy("pos")
        firsts = rest.withColumn("first", (F.row_number().over(of_document) == 1).cast("long"))
        counted = firsts.withColumn("documents", F.sum("first").over(Window.partitionBy("h1", "h2")))
        marked = marked.unionByName(counted.where(F.col("documents") >= min_documents).select("doc", "text_hash", "pos"))
    word, bit = F.floor(F.col("pos") / WORD).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % WORD)
    words = marked.groupBy("doc", "text_hash", word.alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("kept"))
    return words.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "kept"))).alias("words"))


def kept_lines(lines: Column, words: Column) -> Column:
    """The lines that a bitmap keeps."""

    def filled(words):  # every word from 0 to the last listed
        before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(words, i - 1)["word"])
        return F.flatten(F.transform(words, lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), w["word"] - before(i) - 1), F.array(w["kept"]))))

    kept = lambda all_words: F.filter(lines, lambda _, pos: F.coalesce(F.getbit(F.get(all_words, F.floor(pos / WORD).cast("int")), pos % WORD), F.lit(1)) == 1)
    return F.when(words.isNull(), lines).otherwise(let(filled(words), kept))


def drop_common_lines(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_documents: int = 10, min_characters: int = 1) -> DataFrame:
    """df with its text less the lines of common keys, and n_lines (before) and n_dropped.

    A text that is null stays null. The texts are shuffled once, to meet their bitmaps.
    """
    bitmaps = keep_bitmaps(df, id_column, text_column, min_documents, min_characters)
    text = text_of(df, text_column)
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("given"), F.col(id_column).alias("own"), F.xxhash64(text).alias("own_hash"))
    joined = rows.join(bitmaps, F.col("own").eqNullSafe(F.col("doc")) & (F.col("own_hash") == F.col("text_hash")), "left")
    given = lambda c: F.col("given").getField(c)
    lines = lines_of(F.coalesce(given(text_column), F.lit("")))
    kept = joined.withColumn("kept", F.when(F.col("words").isNotNull(), kept_lines(lines, F.col("words"))))
    out = {c: given(c) for c in df.columns} | {
        text_column: F.when(F.col("words").isNull(), given(text_column)).otherwise(F.array_join("kept", "\n")),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.when(F.col("words").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("kept")).cast("long"),
    }
    return kept.select(*[c.alias(n) for n, c in out.items()])
