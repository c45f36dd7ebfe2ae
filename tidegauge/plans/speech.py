"""Filler-word tallies over transcripts.

A transcript is one row, so every count is taken inside the row from its token
array; only monthly and corpus figures shuffle, and those are a few columns wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numbers import half_up
from tidegauge.functions.text import once, speech_tokens

# Disfluencies, doubles that are ordinary English, and hedges.
HARD = ["uh", "um", "umm", "uhh", "uhm", "erm", "mm", "mhm", "hmm", "uhhh", "ummm"]
OK_DOUBLE = ["very", "really", "so", "no", "yes", "ha", "that", "had", "is", "good", "bye", "well", "long", "far",
             "more", "again", "now", "come", "go", "run", "blah"]
HEDGE_UNI = ["like", "basically", "literally", "actually", "obviously", "honestly", "anyway", "whatever"]
HEDGE_BI = [("you", "know"), ("i", "mean"), ("sort", "of"), ("kind", "of"), ("or", "whatever"), ("right", "so")]


def transcript_text(segments: Column) -> Column:
    """All segment texts joined by a space."""
    return F.array_join(F.transform(segments, lambda s: F.coalesce(s["text"], F.lit(""))), " ")


def _pair_in(a: Column, b: Column, pairs: list[tuple[str, str]]) -> Column:
    hit = F.lit(False)
    for first, second in pairs:
        hit = hit | ((a == first) & (b == second))
    return F.coalesce(hit, F.lit(False))


def filler_tally(transcripts: DataFrame, *, hard: list[str] = HARD, hedge_uni: list[str] = HEDGE_UNI,
                 hedge_bi: list[tuple[str, str]] = HEDGE_BI, ok_double: list[str] = OK_DOUBLE,
                 min_tokens: int = 50) -> DataFrame:
    """Counts and rates per transcript; filler words are counted once even where tallies overlap.

    Segments are read once and a text is cut into tokens once; filters on the length of a video come before the latter.
    """
    none = F.array(F.lit(None).cast("string"))
    n = F.col("words")
    last = F.try_element_at("segments", F.lit(-1))
    about = ["video_id", "channel_id", "title", "published_at"]
    base = (
        transcripts.select(*about, once(text=transcript_text(F.col("segments")), parts=F.size("segments"),
                                        dur=(last["offset"] + F.coalesce(last["duration"], F.lit(0))) / 1000.0))
        .where(F.col("parts") > 0).select(*about, "dur", once(tokens=speech_tokens(F.col("text"))))
        .withColumn("words", F.size("tokens").cast("bigint")).where(n >= min_tokens)
        .withColumn("prev", F.concat(none, F.slice("tokens", 1, n.cast("int") - 1)))
        .withColumn("next", F.concat(F.slice("tokens", 2, n.cast("int") - 1), none))
        .withColumn("z", F.arrays_zip(F.col("tokens").alias("t"), F.col("prev").alias("p"), F.col("next").alias("n"))))

    def repeat(x: Column) -> Column:
        return F.coalesce(x["t"] == x["p"], F.lit(False))

    def filler(x: Column) -> Column:
        return (x["t"].isin(hard) | x["t"].isin(hedge_uni) | (repeat(x) & ~x["t"].isin(ok_double))
                | _pair_in(x["p"], x["t"], hedge_bi) | _pair_in(x["t"], x["n"], hedge_bi))

    def count(test) -> Column:
        return F.size(F.filter("z", test)).cast("bigint")

    tallied = base.select(
        "video_id", "channel_id", "title", "published_at", "words", "dur",
        F.filter("tokens", lambda t: t.isin(hard)).alias("hard_tokens"),
        count(repeat).alias("rep_all"), count(lambda x: repeat(x) & ~x["t"].isin(ok_double)).alias("rep"),
        (count(lambda x: x["t"].isin(hedge_uni)) + count(lambda x: _pair_in(x["p"], x["t"], hedge_bi))).alias("hedge"),
        count(filler).alias("filler_words"))
    hard_n = F.size("hard_tokens").cast("bigint")

    def per_100(x: Column) -> Column:
        return F.round(x / n * 100, 2)

    return tallied.withColumn("hard", hard_n).select(
        "video_id", "channel_id", "title", "published_at", half_up(F.col("dur")).alias("duration_sec"), "words",
        F.round(F.try_divide(n, F.col("dur") / 60), 1).alias("wpm"),
        "hard", "rep_all", "rep", "hedge", "filler_words", "hard_tokens",
        per_100(F.col("hard")).alias("hard_per_100"), per_100(F.col("rep")).alias("rep_per_100"),
        per_100(F.col("hedge")).alias("hedge_per_100"), per_100(F.col("filler_words")).alias("filler_per_100"),
        F.round(F.col("hard") / n * F.col("dur"), 1).alias("hard_sec"),
        F.round(F.col("filler_words") / n * F.col("dur"), 1).alias("filler_sec"))


def qualifying(rows: DataFrame, *, min_seconds: int = 300, since: str = "2020-08", channel: str | None = None) -> DataFrame:
    """Long enough and from the era in which disfluencies were transcribed."""
    month = F.date_format("published_at", "yyyy-MM")
    out = rows.where((F.col("duration_sec") >= min_seconds) & (month >= since)).withColumn("month", month)
    return out if channel is None else out.where(F.col("channel_id") == channel)


_SUMS = ["words", "hard", "rep_all", "rep", "hedge", "filler_words", "duration_sec"]


def corpus_totals(rows: DataFrame) -> DataFrame:
    """Each tally over everything: count, per 100 words, and minutes by share of words."""
    sums = rows.agg(F.count(F.lit(1)).alias("videos"), *[F.sum(c).alias(c) for c in _SUMS])
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("tally"), F.col(c).alias("count")) for c in _SUMS[1:-1]]))
    return sums.select("videos", "words", "duration_sec", parts.alias("t")).select(
        "videos", "words", "t.*", F.round(F.col("t.count") / F.col("words") * 100, 4).alias("per_100"),
        F.round(F.col("t.count") / F.col("words") * F.col("duration_sec") / 60, 2).alias("minutes"))


def token_totals(rows: DataFrame) -> DataFrame:
    """How often each disfluency occurs in the corpus."""
    return rows.select(F.explode("hard_tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def monthly_trend(rows: DataFrame) -> DataFrame:
    """Rates per month from summed counts."""
    s = rows.groupBy("month").agg(F.count(F.lit(1)).alias("videos"), *[F.sum(c).alias(c) for c in _SUMS])

    def rate(c: str) -> Column:
        return F.round(F.col(c) / F.col("words") * 100, 4).alias(f"{c}_per_100")

    return s.select("month", "videos", "words", rate("hard"), rate("rep"), rate("hedge"),
                    F.round(F.col("words") / (F.col("duration_sec") / 60), 2).alias("wpm"))


def extremes(rows: DataFrame, *, recent: int = 60, most: int = 8, least: int = 5) -> DataFrame:
    """Most and least disfluent of the latest uploads."""
    last = rows.orderBy(F.desc("published_at"), F.desc("video_id")).limit(recent)
    top = last.orderBy(F.desc("hard_per_100"), "video_id").limit(most).withColumn("list", F.lit("most"))
    low = last.orderBy("hard_per_100", "video_id").limit(least).withColumn("list", F.lit("least"))
    return top.unionByName(low).select("list", "video_id", "hard_per_100", "hard")


def transcriber_diagnostic(rows: DataFrame) -> DataFrame:
    """Share of uploads with no disfluency at all, and the spread of the rest, per month.

    Rates are rounded to two places, so a month's histogram has a bounded number of
    values; the ranks are read off its running count.
    """
    counts = rows.groupBy("month", "hard_per_100").agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.col("hard") == 0).alias("z"))
    order = Window.partitionBy("month").orderBy("hard_per_100")
    ranked = (counts.withColumn("upto", F.sum("c").over(order))
              .withColumn("n", F.sum("c").over(Window.partitionBy("month"))))

    def at(position: Column) -> Column:
        hit = (F.col("upto") > position) & (F.col("upto") - F.col("c") <= position)
        return F.max(F.when(hit, F.col("hard_per_100")))

    return ranked.groupBy("month").agg(
        F.max("n").alias("n"), F.round(F.sum("z") / F.max("n") * 100, 3).alias("zero_pct"),
        at(F.floor(0.1 * (F.col("n") - 1))).alias("p10"), at(F.floor(F.col("n") / 2)).alias("median"),
        at(F.floor(0.9 * (F.col("n") - 1))).alias("p90"))


def level_shift(trend: DataFrame, *, base_from: str, split: str, columns: tuple[str, ...] = ("hard_per_100", "rep_per_100")) -> DataFrame:
    """Unweighted mean of the monthly rates before and after a month, and the change in percent."""
    before = (F.col("month") >= base_from) & (F.col("month") < split)
    after = F.col("month") >= split
    s = trend.select("month", F.explode(F.array(*[
        F.struct(F.lit(c).alias("rate"), F.col(c).alias("v")) for c in columns])).alias("r")).select("month", "r.*")
    return s.groupBy("rate").agg(F.avg(F.when(before, F.col("v"))).alias("b"), F.avg(F.when(after, F.col("v"))).alias("a")).select(
        "rate", F.round("b", 4).alias("before"), F.round("a", 4).alias("after"),
        F.round((F.try_divide("a", "b") - 1) * 100, 2).alias("change_pct"))
