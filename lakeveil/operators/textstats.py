"""Text statistics and verdict (T10, T11), worked out within each row: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that cluster in generated prose, captions that open no sentence, the least length of a
# line of prose, and the bands of the verdict.
TELLS = "delve, robust, comprehensive, leverage, seamless, crucial, pivotal, testament, landscape, realm, underscore, showcase, holistic, cutting-edge, game-changing, meticulous, intricate, myriad, profound, embark, foster, navigate the, tapestry, in today's, it is worth noting, furthermore, moreover, additionally, in conclusion, vibrant".split(", ")
CAPTIONS, LEAST_LINE = "^(Figure|Table|Priority|Measure|[0-9])", 45
# The first two are hundredths, of the deviation of sentence lengths in their mean.
BURSTY, FLAT, DASHES = 45, 25, 1.5


def prose(text: Column) -> Column:
    """Lines of 45 characters or more that don't open with a digit or a caption, joined by one space."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda s: (F.length(s) >= LEAST_LINE) & ~s.rlike(CAPTIONS))
    return F.regexp_replace(F.array_join(kept, " "), r"\s+", " ")


def _commonest(items: Column) -> Column:
    """struct<item, n>: the commonest element of an array, the first seen on ties; by runs of the sorted array."""
    placed = F.sort_array(F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(None).cast("string").alias("item"), F.lit(0).alias("most"), F.lit(0).alias("at"))

    def step(s: Column, e: Column) -> Column:
        again = s["x"].eqNullSafe(e["x"])
        n, i = F.when(again, s["n"] + 1).otherwise(1), F.when(again, s["i"]).otherwise(e["i"])
        better = (n > s["most"]) | ((n == s["most"]) & (i < s["at"]))
        pick = lambda new, old: F.when(better, new).otherwise(old)
        return F.struct(e["x"].alias("x"), n.alias("n"), i.alias("i"), pick(e["x"], s["item"]).alias("item"), pick(n, s["most"]).alias("most"), pick(i, s["at"]).alias("at"))

    return F.aggregate(placed, none, step, lambda s: F.struct(s["item"].alias("item"), s["most"].alias("n")))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with a text's words, sentences, sentence lengths, punctuation, vocabulary, top
    opener and flagged words (``tells``); ``sum_len`` and ``sum_squares`` of sentence lengths are whole numbers, for comparisons that don't hang on rounding. Texts without prose or words (null and empty ones among them) are not in the result; repeated and
    null ids stay as they are."""
    ids = [c for c in docs.columns if c != text]
    rows = docs.select(*ids, prose(F.coalesce(F.col(text), F.lit(""))).alias("__p")).where("__p <> ''")
    lower = F.lower("__p")
    cut = F.transform(F.split("__p", "(?<=[.!?]) "), lambda s: F.array_remove(F.split(F.trim(s), " "), ""))
    rows = rows.withColumn("__w", F.sort_array(F.regexp_extract_all(lower, F.lit("[a-z][a-z'-]*"), F.lit(0)))).where("size(__w) > 0").withColumn("__s", F.filter(cut, lambda w: F.size(w) > 5))
    rows = rows.withColumn("__n", F.transform("__s", lambda w: F.size(w).cast("double")))
    count, sentences = (lambda s: ((F.length("__p") - F.length(F.replace("__p", F.lit(s)))) / len(s)).cast("long")), F.size("__n").cast("long")
    some = lambda c: F.when(sentences > 0, c)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("__mean", some(total(F.col("__n")) / sentences))
    spread = F.sqrt(total(F.transform("__n", lambda x: (x - F.col("__mean")) * (x - F.col("__mean")))) / sentences)
    once = F.size(F.filter(F.transform("__w", lambda w, i: F.when(~w.eqNullSafe(F.get("__w", i - 1)) & ~w.eqNullSafe(F.get("__w", i + 1)), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("__top", some(_commonest(F.transform("__s", lambda w: F.lower(F.concat_ws(" ", F.slice(w, 1, 2)))))))
    return rows.select(
        *ids, count("—").alias("em"), count("–").alias("en"), (count("…") + count("...")).alias("ellipsis"), count(";").alias("semis"),
        F.size("__w").cast("long").alias("words"), F.size(F.array_distinct("__w")).cast("long").alias("distinct_words"), once.cast("long").alias("hapax"),
        some(sentences).alias("sentences"), F.col("__mean").alias("mean_len"), some(spread).alias("sd_len"),
        some(total(F.col("__n")).cast("long")).alias("sum_len"), some(total(F.transform("__n", lambda n: n * n)).cast("long")).alias("sum_squares"),
        some(F.size(F.filter("__n", lambda n: n < 12)).cast("long")).alias("short"), some(F.size(F.filter("__n", lambda n: n > 32)).cast("long")).alias("long"),
        F.col("__top.item").alias("top_opener"), F.col("__top.n").cast("long").alias("opener_count"),
        F.size(F.regexp_extract_all(lower, F.lit("|".join(TELLS)), F.lit(0))).cast("long").alias("tells"),
    )


def verdict(stats: DataFrame) -> DataFrame:
    """PASS, MID or FLAG by burstiness; flags for dashes, ellipses, flagged words and a repeated opening. Burstiness is compared in whole
    numbers: with n sentences, sum a and sum of squares b, (deviation / mean) squared is (n * b - a * a) / (a * a). Without sentences it is zero."""
    n, a, b = (F.col(c).cast("decimal(18,0)") for c in ("sentences", "sum_len", "sum_squares"))
    over = lambda bound: (F.lit(10_000).cast("decimal(5,0)") * (n * b - a * a), F.lit(bound * bound).cast("decimal(4,0)") * (a * a))
    (much, least), (some, most) = over(BURSTY), over(FLAT)
    band = F.when(F.coalesce("sentences", F.lit(0)) == 0, "FLAG").when(much >= least, "PASS").when(some <= most, "FLAG").otherwise("MID")
    flag = lambda bad: F.when(bad, "FLAG").otherwise("PASS")
    dashes = flag(F.col("em") * 1000 > DASHES * F.col("words"))
    opener = F.when(F.coalesce("opener_count", F.lit(0)) <= F.greatest(F.lit(3), F.floor(F.coalesce("sentences", F.lit(0)) / 25)), "PASS").otherwise("FLAG")
    return stats.select("*", band.alias("burstiness_band"), dashes.alias("dash_flag"), opener.alias("opener_flag"), flag(F.col("ellipsis") > 0).alias("ellipsis_flag"), flag(F.col("tells") > 0).alias("word_flag"))
