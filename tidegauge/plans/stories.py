"""Story detection: spiking terms, greedy clusters, trackers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.text import story_tokens, term_set
from tidegauge.session import cut_lineage


def term_postings(videos: DataFrame, *, as_of: str, recent_days: int = 7, baseline_days: int = 60,
                  opener_chars: int | None = None) -> DataFrame:
    """One row per (video, term) of the pool, marked recent or baseline."""
    pool = story_pool(videos, as_of=as_of, recent_days=recent_days, baseline_days=baseline_days)
    tokens = story_tokens(F.col("description"), opener_chars=opener_chars)
    return (pool.select("channel_id", "video_id", "is_recent", tokens.alias("tokens"))
            .select("channel_id", "video_id", "is_recent", F.explode(term_set(F.col("tokens"))).alias("term")))


def recent_postings(videos: DataFrame, *, as_of: str, recent_days: int = 7, baseline_days: int = 60,
                    opener_chars: int | None = None) -> DataFrame:
    """The postings of recent uploads, written once: a small part of the pool that tells which terms matter."""
    return cut_lineage(term_postings(videos, as_of=as_of, recent_days=recent_days, baseline_days=baseline_days,
                                     opener_chars=opener_chars).where("is_recent"))


def frequent_postings(videos: DataFrame, recent: DataFrame, *, as_of: str, recent_days: int = 7, baseline_days: int = 60,
                      min_videos: int = 3, opener_chars: int | None = None, few: int = 700_000) -> DataFrame:
    """The postings of terms that stand in enough recent videos of a channel to spike at all.

    `recent` is the output of `recent_postings` over the same videos; only texts of the baseline are read
    here. The frequent terms are written first, so that Spark knows their size: while they are few it sends
    them to where texts are read, and every other term stays there; beyond that both sides are exchanged,
    and the terms, of which a part holds an even share, are hashed, so that the postings need no sort.
    """
    postings = term_postings(videos, as_of=as_of, recent_days=recent_days, baseline_days=baseline_days, opener_chars=opener_chars)
    often = cut_lineage(recent.groupBy("channel_id", "term").agg(F.count(F.lit(1)).alias("n"))
                        .where(F.col("n") >= min_videos).select("channel_id", "term"))
    if often.count() > few:
        often = often.hint("shuffle_hash")
    return recent.unionByName(postings.where("NOT is_recent")).join(often, ["channel_id", "term"], "left_semi")


def story_pool(videos: DataFrame, *, as_of: str, recent_days: int = 7, baseline_days: int = 60) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return (videos.where(~F.col("is_short") & ~F.col("unavailable") & (F.length("description") > 0)
                         & (F.col("published_at") >= now - F.make_dt_interval(F.lit(baseline_days))))
            .withColumn("is_recent", F.col("published_at") >= now - F.make_dt_interval(F.lit(recent_days))))


def pool_sizes(pool: DataFrame, *, min_recent: int = 3) -> DataFrame:
    """Recent and baseline uploads per channel; channels with too few recent ones drop out."""
    return pool.groupBy("channel_id").agg(
        F.count_if("is_recent").alias("recent_total"), F.count_if(~F.col("is_recent")).alias("base_total")) \
        .where(F.col("recent_total") >= min_recent)


def spike_ratio(recent, recent_total, base, base_total):
    return (recent / recent_total) / ((base + 0.5) / (base_total + 1))


def term_spikes(postings: DataFrame, sizes: DataFrame, *, min_videos: int = 3, min_ratio: float = 3.0) -> DataFrame:
    """Terms far more frequent in recent uploads than in the baseline, per channel."""
    counts = postings.groupBy("channel_id", "term").agg(
        F.count_if("is_recent").alias("recent"), F.count_if(~F.col("is_recent")).alias("base"))
    ratio = spike_ratio(F.col("recent"), F.col("recent_total"), F.col("base"), F.col("base_total"))
    return (counts.where(F.col("recent") >= min_videos).join(sizes, "channel_id")
            .withColumn("ratio", ratio).where(F.col("ratio") >= min_ratio)
            .select("channel_id", "term", "recent", "base", "ratio"))


def spiking_postings(postings: DataFrame, spikes: DataFrame) -> DataFrame:
    """The few postings clustering needs: those of spiking terms."""
    return postings.join(spikes.select("channel_id", "term"), ["channel_id", "term"], "left_semi")


def term_links(spikes: DataFrame, postings: DataFrame, *, overlap: float = 0.35) -> DataFrame:
    """(channel_id, upper, lower, upper_ratio): pairs of spiking terms whose recent videos overlap enough (Jaccard).

    The upper term has the higher ratio, of equal ones the smaller name. Two sets that overlap that
    much share one of their first videos in any common order, so only terms that meet in such a
    prefix are compared; videos with many terms come last in the order and hardly ever bring two together.
    """
    recent = (postings.where("is_recent").select("channel_id", "term", "video_id")
              .join(spikes.select("channel_id", "term", "recent", "ratio"), ["channel_id", "term"]))
    crowd = recent.groupBy("channel_id", "video_id").agg(F.count(F.lit(1)).alias("crowd"))
    rarest = Window.partitionBy("channel_id", "term").orderBy("crowd", "video_id")
    heads = (recent.join(crowd, ["channel_id", "video_id"]).withColumn("place", F.row_number().over(rarest))
             .where(F.col("place") <= F.col("recent") - F.ceil(F.col("recent") * overlap - 1e-9) + 1))
    up = heads.select("channel_id", "video_id", F.col("term").alias("upper"), F.col("ratio").alias("upper_ratio"), F.col("recent").alias("upper_n"))
    down = heads.select("channel_id", "video_id", F.col("term").alias("lower"), F.col("ratio").alias("lower_ratio"), F.col("recent").alias("lower_n"))
    above = (F.col("upper_ratio") > F.col("lower_ratio")) | ((F.col("upper_ratio") == F.col("lower_ratio")) & (F.col("upper") < F.col("lower")))
    sized = F.least("upper_n", "lower_n") >= F.greatest("upper_n", "lower_n") * overlap - 1e-9
    pairs = up.join(down, ["channel_id", "video_id"]).where(above & sized).select(
        "channel_id", "upper", "lower", "upper_ratio", "upper_n", "lower_n").distinct()
    one = recent.select("channel_id", F.col("term").alias("upper"), "video_id")
    two = recent.select("channel_id", F.col("term").alias("lower"), "video_id")
    both = (pairs.join(one, ["channel_id", "upper"]).join(two, ["channel_id", "lower", "video_id"])
            .groupBy("channel_id", "upper", "lower", "upper_ratio", "upper_n", "lower_n").agg(F.count(F.lit(1)).alias("both")))
    return both.where(F.col("both") / (F.col("upper_n") + F.col("lower_n") - F.col("both")) >= overlap).select(
        "channel_id", "upper", "lower", "upper_ratio")


def cluster_terms(spikes: DataFrame, postings: DataFrame, *, overlap: float = 0.35) -> DataFrame:
    """Greedy clusters, all of them: the strongest unused term of a channel takes the unused terms close to it, and so on.

    Equal ratios go by term. The outcome is that of taking one seed after the other, but all terms that
    outrank every undecided term close to them become seeds in the same round, and what is close to a
    seed is decided with it; so the rounds grow with the longest chain of dependent decisions, not with
    the number of clusters. A term belongs to the strongest seed close to it. Clusters are numbered by
    the rank of their seed. `postings` hold those of the spiking terms at least.
    """
    links = cut_lineage(term_links(spikes, postings, overlap=overlap))
    name = ["channel_id", "term"]
    taken, undecided = None, links
    while not undecided.isEmpty():
        below = undecided.select("channel_id", F.col("lower").alias("term"))
        seeds = undecided.select("channel_id", F.col("upper").alias("term")).join(below, name, "left_anti").distinct()
        newly = cut_lineage(undecided.join(seeds.withColumnRenamed("term", "upper"), ["channel_id", "upper"], "left_semi")
                            .select("channel_id", F.col("lower").alias("term")).distinct())
        undecided = cut_lineage(undecided.join(newly.withColumnRenamed("term", "upper"), ["channel_id", "upper"], "left_anti")
                                .join(newly.withColumnRenamed("term", "lower"), ["channel_id", "lower"], "left_anti"))
        taken = newly if taken is None else taken.unionByName(newly)
    if taken is None:
        taken = links.select("channel_id", F.col("lower").alias("term"))
    seeds = spikes.join(taken, name, "left_anti").select("channel_id", F.col("term").alias("seed"), F.col("ratio").alias("seed_ratio"))
    ranked = Window.partitionBy("channel_id").orderBy(F.desc("seed_ratio"), "seed")
    numbered = seeds.withColumn("cluster", F.row_number().over(ranked).cast("bigint")).select("channel_id", "seed", "cluster")
    owner = (links.join(seeds.select("channel_id", F.col("seed").alias("upper")), ["channel_id", "upper"], "left_semi")
             .groupBy("channel_id", F.col("lower").alias("term"))
             .agg(F.min_by("upper", F.struct(-F.col("upper_ratio"), F.col("upper"))).alias("owner")))
    return (spikes.join(owner, name, "left").withColumn("seed", F.coalesce("owner", "term")).join(numbered, ["channel_id", "seed"])
            .select("channel_id", "term", "recent", "base", "ratio", "cluster", "seed"))


def published(clusters: DataFrame, *, limit: int = 6) -> DataFrame:
    """The clusters a report shows: the strongest of each channel."""
    return clusters.where(F.col("cluster") <= limit)


def unpublished(clusters: DataFrame, *, limit: int = 6) -> DataFrame:
    """What a report leaves out, per channel: how many clusters and terms, and the strongest term among them."""
    return (clusters.where(F.col("cluster") > limit).groupBy("channel_id")
            .agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("terms"),
                 F.min_by("term", F.struct(-F.col("ratio"), F.col("term"))).alias("strongest")))


def cluster_videos(clusters: DataFrame, postings: DataFrame) -> DataFrame:
    """Distinct videos matching any term of a cluster."""
    members = clusters.select("channel_id", "cluster", "term")
    return postings.join(members, ["channel_id", "term"]).select(
        "channel_id", "cluster", "video_id", "is_recent").distinct()


def cluster_stats(clusters: DataFrame, postings: DataFrame, sizes: DataFrame) -> DataFrame:
    """Label, saturation and spike ratio of each cluster, on the union of its videos."""
    matched = cluster_videos(clusters, postings).groupBy("channel_id", "cluster").agg(
        F.count_if("is_recent").alias("recent"), F.count_if(~F.col("is_recent")).alias("base"))
    label = clusters.groupBy("channel_id", "cluster").agg(
        F.min_by("term", F.struct(-F.col("recent"), -F.col("ratio"), F.col("term"))).alias("label"),
        F.count(F.lit(1)).alias("terms"))
    return (matched.join(label, ["channel_id", "cluster"]).join(sizes, "channel_id")
            .withColumn("saturation", F.col("recent") / F.col("recent_total"))
            .withColumn("base_saturation", (F.col("base") + 0.5) / (F.col("base_total") + 1))
            .withColumn("ratio", F.col("saturation") / F.col("base_saturation")))


def shown_terms(clusters: DataFrame, *, limit: int = 8) -> DataFrame:
    """Terms listed for a cluster: single words first, then by recent count."""
    order = Window.partitionBy("channel_id", "cluster").orderBy(
        F.size(F.split("term", " ")), F.desc("recent"), F.desc("ratio"), "term")
    return clusters.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def tracker_keywords(clusters: DataFrame, *, limit: int = 12) -> DataFrame:
    """Keywords exported with a tracker: the seed, then by ratio."""
    order = Window.partitionBy("channel_id", "cluster").orderBy(
        (F.col("term") != F.col("seed")).cast("int"), F.desc("ratio"), "term")
    return clusters.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def trackers(stats: DataFrame, labels: DataFrame, *, min_saturation: float = 0.30) -> DataFrame:
    """Clusters hot enough to track, named by the label table where it knows them."""
    return (stats.where(F.col("saturation") >= min_saturation)
            .join(labels.select(F.col("term_id").alias("label"), "display_name"), "label", "left")
            .select("channel_id", "cluster", F.col("label").alias("term_id"), F.coalesce("display_name", "label").alias("name"),
                    F.round("saturation", 4).alias("recent_saturation"), F.round("base_saturation", 4).alias("base_saturation"),
                    F.round("ratio", 2).alias("spike_ratio"), "recent", "base"))


def sample_videos(clusters: DataFrame, postings: DataFrame, videos: DataFrame, *, limit: int = 5) -> DataFrame:
    """The newest recent videos of every cluster."""
    newest = Window.partitionBy("channel_id", "cluster").orderBy(F.desc("published_at"), "video_id")
    return (cluster_videos(clusters, postings).where("is_recent")
            .join(videos.select("video_id", "published_at"), "video_id")
            .withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit))


def keyword_saturation(keywords: DataFrame, postings: DataFrame, sizes: DataFrame) -> DataFrame:
    """Share of recent and baseline videos matching any keyword of a tracker."""
    matched = (postings.join(keywords.select("channel_id", "tracker", F.col("keyword").alias("term")), ["channel_id", "term"])
               .select("channel_id", "tracker", "video_id", "is_recent").distinct()
               .groupBy("channel_id", "tracker").agg(
                   F.count_if("is_recent").alias("recent"), F.count_if(~F.col("is_recent")).alias("base")))
    return matched.join(sizes, "channel_id").withColumn("saturation", F.col("recent") / F.col("recent_total"))


def suppressed_clusters(matched: DataFrame, keywords: DataFrame, postings: DataFrame, *, overlap: float = 0.5) -> DataFrame:
    """Detector clusters whose recent videos mostly coincide with a hand-labelled tracker's.

    `matched` is the output of `cluster_videos`; `postings` must hold the tracker's keywords.
    """
    # Both are read twice, and hold one row per video.
    found = cut_lineage(matched.where("is_recent").select("channel_id", "cluster", "video_id"))
    manual = cut_lineage(postings.where("is_recent").join(keywords.select("channel_id", "tracker", F.col("keyword").alias("term")), ["channel_id", "term"])
                         .select("channel_id", "tracker", "video_id").distinct())
    both = found.join(manual, ["channel_id", "video_id"]).groupBy("channel_id", "cluster", "tracker").agg(F.count(F.lit(1)).alias("both"))
    a = found.groupBy("channel_id", "cluster").agg(F.count(F.lit(1)).alias("a"))
    b = manual.groupBy("channel_id", "tracker").agg(F.count(F.lit(1)).alias("b"))
    return (both.join(a, ["channel_id", "cluster"]).join(b, ["channel_id", "tracker"])
            .withColumn("jaccard", F.col("both") / (F.col("a") + F.col("b") - F.col("both")))
            .where(F.col("jaccard") >= overlap).select("channel_id", "cluster", "tracker", F.round("jaccard", 4).alias("jaccard")))
