"""Keyword tagging and the upkeep of topic ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.text import name_colour, name_key, phrase_key, slug, snippet
from tidegauge.operators.keywords import keyword_counts
from tidegauge.operators.selections import usable_name
from tidegauge.session import cut_lineage


def usable_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """(topic_id, keyword) of topics that can score: ids not starting with '_'; rows without a keyword never hit."""
    return taxonomy.where("NOT startswith(topic_id, '_') AND length(keyword) > 0").select("topic_id", "keyword")


def topic_scores(videos: DataFrame, transcripts: DataFrame, taxonomy: DataFrame, *,
                 weights: tuple[float, float, float] = (3.0, 1.5, 1.0)) -> DataFrame:
    """(video_id, topic_id, title_score, total_score) of every topic that a video mentions at all.

    Titles and descriptions are scored where `videos` holds them, the words spoken where `transcripts`
    (video_id, transcript) does; only the counts are brought together.
    """
    usable = usable_taxonomy(taxonomy)
    written = keyword_counts(videos, ["title", "description"], usable).withColumn("transcript", F.lit(0).cast("bigint"))
    spoken = keyword_counts(transcripts, ["transcript"], usable).select(
        "video_id", "topic_id", F.lit(0).cast("bigint").alias("title"), F.lit(0).cast("bigint").alias("description"), "transcript")
    hits = written.unionByName(spoken).groupBy("video_id", "topic_id").agg(*(F.sum(c).alias(c) for c in ("title", "description", "transcript")))
    title = F.col("title") * weights[0]
    return hits.select("video_id", "topic_id", title.alias("title_score"),
                       (title + F.col("description") * weights[1] + F.col("transcript") * weights[2]).alias("total_score"))


def pick_topic(scores: DataFrame, *, min_score: float = 3.0, fallback: tuple[str, ...] = ("livestream",)) -> DataFrame:
    """Best topic of each video that has one: real subjects before format topics, then title, total, id."""
    order = F.struct(F.col("topic_id").isin(*fallback).cast("int").alias("f"), (-F.col("title_score")).alias("a"),
                     (-F.col("total_score")).alias("b"), "topic_id")
    return scores.where(F.col("total_score") >= min_score).groupBy("video_id").agg(F.min(order)["topic_id"].alias("topic_id"))


def tag_videos(videos: DataFrame, picked: DataFrame, overrides: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row per video, its topic or null. Overrides pin or untag single videos; one to an unknown topic is ignored."""
    known = usable_taxonomy(taxonomy).select(F.col("topic_id").alias("forced")).distinct().withColumn("known", F.lit(True))
    forced = (overrides.select("video_id", F.col("topic_id").alias("forced")).join(known, "forced", "left")
              .where("forced IS NULL OR known").select("video_id", "forced", F.lit(True).alias("use")))
    j = videos.select("video_id").join(picked, "video_id", "left").join(forced, "video_id", "left")
    use = F.coalesce("use", F.lit(False))
    return j.select("video_id", F.when(use, F.col("forced")).otherwise(F.col("topic_id")).alias("topic_id"),
                    (use & ~F.col("forced").eqNullSafe(F.col("topic_id"))).alias("overridden"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.where("topic_id IS NOT NULL").groupBy("topic_id").agg(F.count(F.lit(1)).alias("videos"))


def tag_stats(tags: DataFrame) -> DataFrame:
    return tags.agg(F.count("topic_id").alias("tagged"), F.count_if(F.col("topic_id").isNull()).alias("untagged"),
                    F.count(F.lit(1)).alias("targets"), F.count_if("overridden").alias("overridden"))


def referenced_ids(topics: DataFrame) -> DataFrame:
    """Ids that another topic's related or claims list points at."""
    both = F.concat(F.coalesce("related", F.array()), F.coalesce("claims", F.array()))
    return topics.select(F.explode(both).alias("topic_id")).distinct()


def survivors(topics: DataFrame, tags: DataFrame, promoted: DataFrame) -> DataFrame:
    """Per name key the id that survives: promoted, then referenced, then most videos, then shorter name."""
    score = (F.coalesce("promoted", F.lit(0)) * 1000000 + F.coalesce("referenced", F.lit(0)) * 100000
             + F.coalesce("videos", F.lit(0)) * 10 - F.least(F.lit(9.0), F.length("name") / 10.0))
    subjects = (
        topics.where("kind = 'subject'").select("topic_id", "name", name_key(F.col("name")).alias("key"))
        .where(F.length("key") > 0)
        .join(tag_counts(tags), "topic_id", "left")
        .join(promoted.select("topic_id", F.lit(1).alias("promoted")), "topic_id", "left")
        .join(referenced_ids(topics).withColumn("referenced", F.lit(1)), "topic_id", "left")
        .withColumn("score", score))
    best = subjects.groupBy("key").agg(F.min_by("topic_id", F.struct(-F.col("score"), F.col("topic_id"))).alias("best"))
    return subjects.select("topic_id", "key").join(best, "key")


def canon_map(topics: DataFrame, tags: DataFrame, promoted: DataFrame, aliases: DataFrame, *, grouped: DataFrame | None = None) -> DataFrame:
    """Variant id -> canonical id: automatic name groups, overridden by the alias table, chains resolved.

    `grouped` is the output of `survivors` if a caller has it already.

    A round joins the map with itself and so doubles its reach. While a chain of any length is
    unresolved, each round resolves some id of it; once a round resolves none, what still points at
    a variant lies on a cycle or leads into one, and is left alone.
    """
    groups = survivors(topics, tags, promoted) if grouped is None else grouped
    auto = groups.where("topic_id <> best").select(
        F.col("topic_id").alias("variant"), F.col("best").alias("target"), F.lit(0).alias("_v"))
    manual = (aliases.where("variant_id <> topic_id")
              .join(topics.select("topic_id"), "topic_id", "left_semi")
              .select(F.col("variant_id").alias("variant"), F.col("topic_id").alias("target"), F.lit(1).alias("_v")))
    edges = cut_lineage(auto.unionByName(manual).groupBy("variant").agg(F.max_by("target", "_v").alias("target")))

    open_before = -1
    while True:
        step = edges.select(F.col("variant").alias("target"), F.col("target").alias("beyond"))
        joined = edges.join(step, "target", "left")
        still_open = joined.where("beyond IS NOT NULL").count()
        if still_open in (0, open_before):
            return joined.where("beyond IS NULL").select("variant", F.col("target").alias("canonical"))
        open_before = still_open
        edges = cut_lineage(joined.select("variant", F.coalesce("beyond", "target").alias("target")))


def invalid_aliases(aliases: DataFrame, topics: DataFrame) -> DataFrame:
    return aliases.where("variant_id <> topic_id").join(topics.select("topic_id"), "topic_id", "left_anti")


def refile(tags: DataFrame, canon: DataFrame) -> DataFrame:
    """Move every tag to its canonical id."""
    c = canon.select(F.col("variant").alias("topic_id"), "canonical")
    return tags.join(c, "topic_id", "left").select(
        "video_id", F.coalesce("canonical", "topic_id").alias("topic_id"), F.col("canonical").isNotNull().alias("moved"))


def orphaned(topics: DataFrame, refiled: DataFrame, canon: DataFrame) -> DataFrame:
    """Folded ids nothing points at any more; folding has already un-promoted them."""
    folded = canon.select(F.col("variant").alias("topic_id"))
    return (topics.select("topic_id").join(folded, "topic_id", "left_semi")
            .join(referenced_ids(topics), "topic_id", "left_anti")
            .join(refiled.select("topic_id").distinct(), "topic_id", "left_anti"))


def merge_counts(refiled: DataFrame, promoted: DataFrame, topics: DataFrame, canon: DataFrame) -> DataFrame:
    """Tags moved, folded ids un-promoted, orphaned definitions removed."""
    folded = canon.select(F.col("variant").alias("topic_id"))
    counts = [refiled.where("moved").select(F.lit("moved").alias("what")),
              promoted.join(folded, "topic_id", "left_semi").select(F.lit("demoted").alias("what")),
              orphaned(topics, refiled, canon).select(F.lit("removed").alias("what"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def alias_candidates(topics: DataFrame, tags: DataFrame, canon: DataFrame) -> DataFrame:
    """Tagged subjects sharing the first and last word of their key but not their canonical id."""
    words = F.split(name_key(F.col("name")), " ")
    ends = (topics.where("kind = 'subject'").join(tags.select("topic_id").distinct(), "topic_id", "left_semi")
            .withColumn("w", words).where(F.size("w") >= 2)
            .withColumn("ends", F.concat_ws(" ", F.col("w")[0], F.element_at("w", -1)))
            .join(canon.select(F.col("variant").alias("topic_id"), "canonical"), "topic_id", "left")
            .select("ends", F.coalesce("canonical", "topic_id").alias("topic_id")).distinct())
    several = ends.groupBy("ends").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return ends.join(several, "ends")


def backfill(raw: DataFrame, tags: DataFrame, topics: DataFrame, canon: DataFrame, grouped: DataFrame) -> DataFrame:
    """File untagged videos under their stored subject name.

    `raw` holds (video_id, name) of classified videos, `grouped` the output of
    `survivors`. Names resolve by alias of the slug, by slug, then by name key; the
    rest become new topics, one per key, named by the lowest video id.
    """
    todo = (raw.where(usable_name(F.col("name"))).join(tags.where("topic_id IS NOT NULL").select("video_id"), "video_id", "left_anti")
            .select("video_id", F.trim("name").alias("name")))
    # written before the filter and the three uses below, each of which would work the names out again
    todo = cut_lineage(todo.withColumn("slug", slug(F.col("name"))).withColumn("key", name_key(F.col("name")))).where(F.length("slug") > 0)
    by_slug = canon.select(F.col("variant").alias("slug"), F.col("canonical").alias("c1"))
    kinds = topics.select(F.col("topic_id").alias("slug"), F.col("kind").alias("slug_kind"))
    by_key = (grouped.select("key", F.col("best").alias("variant")).distinct()
              .join(canon, "variant", "left").select("key", F.coalesce("canonical", "variant").alias("c3")))
    j = todo.join(by_slug, "slug", "left").join(kinds, "slug", "left").join(by_key, "key", "left")
    found = F.coalesce("c1", F.when(F.col("slug_kind") == "subject", F.col("slug")), "c3")
    j = j.withColumn("found", found)
    fresh = j.where("found IS NULL AND slug_kind IS NULL")
    own = F.when(F.length("key") > 0, F.col("key")).otherwise(F.col("slug"))
    named = fresh.groupBy(own.alias("own")).agg(F.min_by(F.struct("name", "slug"), "video_id").alias("rep"))
    created = (fresh.withColumn("own", own).join(named, "own")
               .select("video_id", F.col("rep.slug").alias("topic_id"), F.col("rep.name").alias("topic_name"),
                       F.lit("created").alias("how")))
    joined = j.where("found IS NOT NULL").select(
        "video_id", F.col("found").alias("topic_id"), F.lit(None).cast("string").alias("topic_name"),
        F.when(F.col("found") == F.col("slug"), "joined").otherwise("folded").alias("how"))
    return joined.unionByName(created)


def new_definitions(filed: DataFrame) -> DataFrame:
    """Topic definitions created by a backfill, with their colour; keys of one slug share the name of the lowest video id."""
    return (filed.where("how = 'created'").groupBy("topic_id").agg(F.min_by("topic_name", "video_id").alias("name"))
            .select("topic_id", "name", name_colour(F.col("name")).alias("colour"), F.lit("subject").alias("kind")))


def contained_phrases(videos: DataFrame, phrases: DataFrame) -> DataFrame:
    """(video, phrase owner) pairs where the title holds the phrase as whole words.

    Titles are cut into all runs of up to the longest phrase's word count and joined
    on equality, so no title is compared with a phrase it does not contain.
    """
    keyed = phrases.withColumn("phrase", F.trim(phrase_key(F.col("name")))).where(F.length("phrase") > 0)
    longest = keyed.agg(F.max(F.size(F.split("phrase", " ")))).scalar()
    words = F.split(F.trim(phrase_key(F.col("title"))), " ")
    titled = (videos.select("video_id", words.alias("w")).withColumn("n", F.size("w"))
              .withColumn("most", F.least(F.col("n"), longest)))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.col("most")), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("n") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    return titled.select("video_id", F.explode(F.array_distinct(runs)).alias("phrase")).join(keyed, "phrase")


def cede_to_person(videos: DataFrame, tags: DataFrame, modes: DataFrame, topics: DataFrame) -> DataFrame:
    """Re-file videos whose title names a person onto that person's id; `modes` has the format of a video or null.

    Clusters are tried in their declared order; the first that already holds the tag,
    or may take it, decides.
    """
    clusters = topics.where("NOT startswith(topic_id, '_') AND (related IS NOT NULL OR claims IS NOT NULL)").select(
        F.col("topic_id").alias("person"), "name", "ord",
        F.concat(F.coalesce("related", F.array()), F.coalesce("claims", F.array())).alias("cede"))
    named = contained_phrases(videos.where("NOT is_short AND title IS NOT NULL"), clusters)
    cur = (named.join(tags.select("video_id", F.col("topic_id").alias("cur")), "video_id", "left")
           .join(modes.where("mode IS NOT NULL").select("video_id", F.lit(True).alias("has_mode")), "video_id", "left"))
    stay = F.coalesce(F.col("cur") == F.col("person"), F.lit(False))
    take = ((F.col("cur").isNull() & F.coalesce("has_mode", F.lit(False)))
            | F.coalesce(F.array_contains("cede", F.col("cur")), F.lit(False)))
    decided = cur.where(stay | take).groupBy("video_id").agg(
        F.min_by(F.struct("person", "cur", stay.alias("stay")), "ord").alias("d"))
    return decided.where("NOT d.stay").select(
        "video_id", F.col("d.cur").alias("from_topic"), F.col("d.person").alias("topic_id"))


def topic_totals(videos: DataFrame, tags: DataFrame, topics: DataFrame) -> DataFrame:
    """Videos and views per topic; a person also shows its related topics, which keep their own line."""
    own = (tags.where("topic_id IS NOT NULL").join(videos.select("video_id", "views"), "video_id").groupBy("topic_id")
           .agg(F.count(F.lit(1)).alias("videos"), F.sum("views").alias("views")))
    under = (topics.where("related IS NOT NULL").select(F.col("topic_id").alias("shown"), F.explode("related").alias("topic_id"))
             .join(own, "topic_id").select("shown", "topic_id", "videos", "views", F.lit(True).alias("is_related")))
    return own.select(F.col("topic_id").alias("shown"), "topic_id", "videos", "views", F.lit(False).alias("is_related")) \
        .unionByName(under)


def newly_promoted(tags: DataFrame, promoted: DataFrame, *, floor: int = 3) -> DataFrame:
    """Subjects that reached the video floor since the last run."""
    return tag_counts(tags).where(F.col("videos") >= floor).join(promoted.select("topic_id"), "topic_id", "left_anti")


def enriched(rows: DataFrame, axes: dict[str, DataFrame], topics: DataFrame,
             descriptions: DataFrame | None = None) -> DataFrame:
    """Topic chips (subject, theme, format) beside each row; rows without any keep an empty list.

    With `descriptions` (video_id, description) each row also gets a one-line snippet, empty where there
    is no text; it is cut before the join, so no whole text is moved.
    """
    out = rows
    if descriptions is not None:
        previews = descriptions.select("video_id", snippet(F.col("description")).alias("snippet"))
        out = out.join(previews, "video_id", "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))
    chips = []
    for axis, tags in axes.items():
        chip = (tags.join(topics.select("topic_id", "name", F.coalesce("colour", F.lit("#888")).alias("colour")), "topic_id")
                .select("video_id", F.concat_ws("|", F.lit(axis), "name", "colour").alias(f"_{axis}")))
        out = out.join(chip, "video_id", "left")
        chips.append(F.col(f"_{axis}"))
    return out.withColumn("chips", F.array_join(F.array_compact(F.array(*chips)), ";")).drop(*[f"_{a}" for a in axes])
