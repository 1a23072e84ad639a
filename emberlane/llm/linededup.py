"""Line dedup by a suffix array over line-id sequences, in DataFrame functions only.

Method. Lines with a word get ids; each document is a sequence of ids. Prefix doubling ranks every suffix by
its first 1, 2, 4, ... lines: a round pairs the rank of a suffix with the rank of the suffix ``h`` lines on,
ranks the distinct pairs in sorted order and joins the ranks back. Suffixes whose rank is theirs alone are
finished and leave. Suffixes of equal rank at depth ``h`` are an interval of the suffix array whose longest
common prefix has ``h`` lines at least; an interval of a depth ``l`` between ``h`` and ``2 h`` has equal ranks
at its start and ``l - h`` lines on. A run of lines counts if it has ``min_words`` words in all. It is looked
for at the depths at which it is tight, having too few words without its first line or without its last; the
intervals at that depth hold all its copies. Members that are not an interval's first occurrence start later
copies, whose lines are deleted. Every repeated run that counts is the union of such copies, so maximal runs
are deleted whole, however long.

Scale. Only ids move, two hashes a line; each text is shuffled once, to meet the lines to delete. Ranks are
counted over distinct pairs that were summed before the shuffle, so one very common line is one row there;
joining ranks back is a plain equi-join that Spark splits where a rank is hot. Rounds double the depth up to
``min_words`` lines, as each line has a word. Nothing is gathered on the driver.

Edge cases. The first occurrence in (document id, position) order stays, also within a document; a null
id sorts first. Lines without a word are no part of runs and always stay. Null text has no lines.
Repeated rows (equal id and text) are one document: each gets the same result. Lines of any number and
length work. An empty table gives no rows. Other columns, whatever their names, are carried in a struct.
Lines are compared by 128 bits of hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.llm.scratch import discard, materialize

HAS_WORD = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
_ME = ("d", "t", "p")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_table(df: DataFrame, text: Column, min_words: int) -> DataFrame:
    """``d, t, p, a, b, least, most`` of every line with a word: its hash ``a, b``, and the lengths of tight runs that start with it."""
    entry = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.size(F.split(F.btrim(x, F.lit(SPACES)), GAP)).alias("w"))
    df = df.withColumn("_e", F.transform(F.filter(_lines(text), lambda x: x.rlike(HAS_WORD)), entry))

    def need(i: Column) -> Column:
        near = F.slice("_e", i + 1, F.least(F.lit(min_words), F.size("_e") - i))
        start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("l"))
        step = lambda acc, e: F.when(acc["s"] >= min_words, acc).otherwise(F.struct((acc["s"] + e["w"]).alias("s"), (acc["l"] + 1).alias("l")))
        return F.aggregate(near, start, step, lambda acc: F.when(acc["s"] >= min_words, acc["l"]))

    df = df.withColumn("_n", F.transform("_e", lambda e, i: need(i)))
    least = lambda i: F.get("_n", i)
    most = lambda i: F.when(least(i).isNotNull(), F.greatest(least(i), F.coalesce(least(i + 1), F.size("_n") - i)))
    each = F.transform("_e", lambda e, i: F.struct(e["a"].alias("a"), e["b"].alias("b"), least(i).alias("least"), most(i).alias("most")))
    out = df.select("d", "t", F.posexplode(each).alias("p", "x")).select("d", "t", "p", "x.a", "x.b", "x.least", "x.most")
    return out.groupBy(*_ME).agg(*[F.min(c).alias(c) for c in ("a", "b", "least", "most")])  # repeated rows are one document


def _intervals(rows: DataFrame, by: list[str]) -> DataFrame:
    """The groups of ``rows`` with equal ``by`` that have two members or more, and their first occurrence."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_many"), F.min(F.struct(*_ME)).alias("first")).where("_many > 1")


def _met(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    table = table.withColumnsRenamed({c: f"_{c}" for c in by})
    return rows.join(table, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in by]))


def _later() -> Column:
    return ~F.struct(*_ME).eqNullSafe(F.col("first"))


def later_copies(lines: DataFrame, min_words: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """``d, t, p, n``: where a later copy of a tight run starts, and how many lines it has; and the written levels."""
    levels: list[DataFrame] = []
    copies: list[DataFrame] = []
    ahead = lambda n: F.first("rank").over(Window.partitionBy("d", "t").orderBy("p").rangeBetween(n, n))
    now, by, h = lines, ["a", "b"], 1
    while h <= min_words:
        # ranks number the intervals in their order: range partitions, sorted, numbered through
        ranks = _intervals(now, by).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())
        level = _met(now, ranks.select(*by, "rank", "first"), by).select(*_ME, "least", "most", "rank", _later().alias("later"))
        level = materialize(level, f"suffixes{h}")
        if level.isEmpty():
            discard(level)
            break
        levels.append(level)
        copies.append(level.where(F.lit(h).between(F.col("least"), F.col("most")) & F.col("later")).select(*_ME, F.lit(h).alias("n")))
        over = min(h - 1, min_words - h)
        if over > 0:  # depths between this and the next
            ends = level.select(*_ME, "least", "most", "rank", F.array(*[ahead(n) for n in range(1, over + 1)]).alias("ends"))
            low, high = F.greatest(F.col("least") - h, F.lit(1)), F.least(F.col("most") - h, F.lit(over))
            each = ends.where(F.col("least").isNotNull() & (low <= high)).select(*_ME, "rank", "ends", F.explode(F.sequence(low, high)).alias("x"))
            each = each.select(*_ME, (F.col("x") + h).alias("n"), "rank", F.get("ends", F.col("x") - 1).alias("end")).where("end is not null")
            keys = ["n", "rank", "end"]
            copies.append(_met(each, _intervals(each, keys).select(*keys, "first"), keys).where(_later()).select(*_ME, "n"))
        now = level.select(*_ME, "least", "most", F.col("rank").alias("r1"), ahead(h).alias("r2")).where("r2 is not null")
        by, h = ["r1", "r2"], h * 2
    return copies, levels


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8) -> DataFrame:
    """One row per input row: ``row`` (a struct of its columns), ``kept_text``, ``n_lines``, ``n_removed``, and the maximal runs removed.

    ``runs`` has their first line and length, counting the lines that have a word.
    """
    text = F.col("row")[text_col]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    df = df.withColumn("d", F.col("row")[id_col].cast("long")).withColumn("t", F.xxhash64(F.coalesce(text, F.lit(""))))
    lines = line_table(docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("t"), F.col(f"`{text_col}`").alias("_x")), F.col("_x"), min_words)
    lines = materialize(lines, "lines")
    copies, levels = later_copies(lines, min_words)
    if not levels:
        return df.select("row", text.alias("kept_text"), _count(text), *_summary(F.array().cast("array<int>")))
    hits = reduce(DataFrame.unionAll, copies).select("d", "t", F.sequence("p", F.col("p") + F.col("n") - 1).alias("at"))
    gone = hits.groupBy("d", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    gone = materialize(gone.select(F.col("d").alias("_d"), F.col("t").alias("_t"), "at"), "deleted")
    discard(lines, *levels)
    # what is to be deleted grows with the texts and has no bound of its own, so it is never broadcast
    out = df.join(gone.hint("merge"), F.col("d").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left")
    out = out.withColumn("raw", _lines(text))
    out = out.withColumn("worded", F.filter(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: F.get("raw", i).rlike(HAS_WORD)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), F.transform("at", lambda p: F.get("worded", p)))
    kept = F.when(F.col("at").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("raw", i)), "\n"))
    return out.select("row", kept.alias("kept_text"), _count(text), *_summary(F.coalesce("at", F.array().cast("array<int>"))))


def _count(text: Column) -> Column:
    return F.size(_lines(text)).cast("bigint").alias("n_lines")


def _summary(at: Column) -> list[Column]:
    """How many lines are removed, and the maximal runs of them; ``at`` is sorted."""
    starts = F.filter(at, lambda p, i: (i == 0) | (F.get(at, i - 1) != p - 1))
    ends = F.filter(at, lambda p, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != p + 1))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("lines")))
    return [F.size(at).cast("bigint").alias("n_removed"), runs.alias("runs")]
