"""Catalogue upkeep: merges, availability, titles, descriptions, reasons, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numbers import is_short
from tidegauge.operators.blocks import previous_row, streaks


def merge_latest(existing: DataFrame, fresh: DataFrame, *, key: str = "video_id") -> DataFrame:
    """Union by key; the fresh row replaces the stored one. One shuffle, no join."""
    cols = existing.columns
    both = (existing.select(*cols, F.lit(0).alias("_v")).unionByName(fresh.select(*cols, F.lit(1).alias("_v"))))
    rest = [c for c in cols if c != key]
    return (both.groupBy(key).agg(F.max_by(F.struct(*rest), "_v").alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*cols))


def apply_observations(catalogue: DataFrame, answers: DataFrame, *, as_of: str) -> DataFrame:
    """Bring the catalogue up to date with one pass of answers.

    An id without an answer keeps its last-known figures and becomes unavailable
    (the first such time is kept); an answer clears the flag and settles the format anew.
    """
    figures = ["views", "likes", "comments", "duration_sec"]
    heard = answers.select("video_id", *[F.col(c).alias(f"new_{c}") for c in figures], F.lit(True).alias("heard"))
    j = catalogue.join(heard, "video_id", "left").withColumn("heard", F.coalesce("heard", F.lit(False)))
    now = F.lit(as_of).cast("timestamp")
    rest = [c for c in catalogue.columns if c not in (*figures, "unavailable", "unavailable_since")]
    if "is_short" in rest:
        j = j.withColumn("is_short", F.when(F.col("heard"), is_short(F.col("new_duration_sec"), F.col("published_at"))).otherwise(F.col("is_short")))
    return j.select(
        *rest,
        *[F.when(F.col("heard"), F.col(f"new_{c}")).otherwise(
            F.coalesce(c, F.lit(0)) if c in ("views", "duration_sec") else F.col(c)).alias(c) for c in figures],
        (~F.col("heard")).alias("unavailable"),
        F.when(~F.col("heard"), F.coalesce("unavailable_since", now)).alias("unavailable_since"))


def apply_privacy(catalogue: DataFrame, statuses: DataFrame, *, as_of: str) -> DataFrame:
    """'unlisted' sets flag and stamp once, 'public' clears them, anything else changes nothing."""
    j = catalogue.join(statuses.select("video_id", "privacy_status"), "video_id", "left")
    set_it = F.coalesce(F.col("privacy_status") == "unlisted", F.lit(False))
    clear = F.coalesce(F.col("privacy_status") == "public", F.lit(False))
    now = F.lit(as_of).cast("timestamp")
    return (j.withColumn("newly_unlisted", set_it & ~F.col("unlisted"))
            .withColumn("unlisted_since", F.when(F.col("newly_unlisted"), now).when(~clear, F.col("unlisted_since")))
            .withColumn("unlisted", set_it | (F.col("unlisted") & ~clear)).drop("privacy_status"))


def absence_streaks(presence: DataFrame) -> DataFrame:
    """How many passes in a row a video has been missing, at every pass."""
    return streaks(presence, "video_id", "pass_id", ~F.col("present"))


def availability_events(presence: DataFrame, *, rechecks: int = 3) -> DataFrame:
    """newly_unavailable once the absence is confirmed, restored when it then answers again."""
    missing = absence_streaks(presence)
    seen = previous_row(missing, "video_id", "pass_id", ["streak"])
    gone = F.col("streak") == rechecks + 1
    back = F.col("present") & (F.col("prev_streak") >= rechecks + 1)
    return (seen.withColumn("event", F.when(gone, "newly_unavailable").when(back, "restored"))
            .where("event IS NOT NULL").select("video_id", "pass_id", "observed_at", "event"))


def confirmed_absences(presence: DataFrame, *, rechecks: int = 3) -> DataFrame:
    """Videos whose latest passes were all misses, often enough to believe it."""
    last = absence_streaks(presence).groupBy("video_id").agg(F.max_by("streak", "pass_id").alias("streak"))
    return last.where(F.col("streak") > rechecks)


def bulk_removal_guard(presence: DataFrame, *, rechecks: int = 3, bulk_over: int = 10) -> DataFrame:
    """Per pass: removals believed at once or only after one more pass, and those that came back."""
    ahead = Window.partitionBy("video_id").orderBy("pass_id")
    nexts = presence.withColumn("next_present", F.lead("present").over(ahead)).select("video_id", "pass_id", "next_present")
    gone = availability_events(presence, rechecks=rechecks).where("event = 'newly_unavailable'")
    came_back = F.coalesce("next_present", F.lit(False))
    per_pass = (gone.join(nexts, ["video_id", "pass_id"]).groupBy("pass_id")
                .agg(F.count(F.lit(1)).alias("flagged"), F.count_if(came_back).alias("back")))
    bulk = F.col("flagged") > bulk_over
    returned = F.when(bulk, F.col("back")).otherwise(F.lit(0))
    return (per_pass.withColumn("returned", returned.cast("bigint"))
            .withColumn("confirmed", F.col("flagged") - F.col("returned"))
            .select("pass_id", "flagged", "returned", "confirmed", (F.col("confirmed") > bulk_over).alias("warn")))


def deletion_sweep(stored: DataFrame, listing: DataFrame, *, since: str) -> DataFrame:
    """Stored in-window videos that the live listing no longer shows."""
    return (stored.where(F.col("published_at") >= F.lit(since).cast("timestamp"))
            .join(listing.select("video_id"), "video_id", "left_anti"))


def title_changes(observations: DataFrame) -> DataFrame:
    """Every later sighting whose title differs from the one before; empty titles are ignored."""
    usable = observations.where(F.coalesce(F.length("title"), F.lit(0)) > 0)
    seen = previous_row(usable, "video_id", "pass_id", ["title"])
    return (seen.where(F.col("prev_title").isNotNull() & (F.col("title") != F.col("prev_title")))
            .select("video_id", "pass_id", F.col("prev_title").alias("from_title"), F.col("title").alias("to_title"), "via"))


def title_ledger(observations: DataFrame) -> DataFrame:
    """First and current title per video."""
    usable = observations.where(F.coalesce(F.length("title"), F.lit(0)) > 0)
    return usable.groupBy("video_id").agg(F.min_by("title", "pass_id").alias("first_title"),
                                          F.max_by("title", "pass_id").alias("current_title"))


def title_summary(observations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Videos tracked, videos ever re-titled, changes in total; ids gone from the catalogue are pruned."""
    observations = observations.join(catalogue.select("video_id"), "video_id", "left_semi")
    changes = title_changes(observations).groupBy("video_id").agg(F.count(F.lit(1)).alias("c"))
    return (title_ledger(observations).join(changes, "video_id", "left").agg(
        F.count(F.lit(1)).alias("tracked"), F.count("c").alias("retitled"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("changes")))


def upsert_descriptions(stored: DataFrame, fresh: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Fresh descriptions win; ids no longer in the catalogue are dropped."""
    return merge_latest(stored, fresh).join(catalogue.select("video_id"), "video_id", "left_semi")


def channel_day_upsert(stored: DataFrame, fresh: DataFrame, *, keep_last: int | None = None) -> DataFrame:
    """One row per (channel, day), the fresh one if there is one; optionally the latest N days only."""
    cols = stored.columns
    both = stored.select(*cols, F.lit(0).alias("_v")).unionByName(fresh.select(*cols, F.lit(1).alias("_v")))
    rest = [c for c in cols if c not in ("channel_id", "day")]
    merged = (both.groupBy("channel_id", "day").agg(F.max_by(F.struct(*rest), "_v").alias("_r"))
              .select("channel_id", "day", *[F.col(f"_r.{c}").alias(c) for c in rest]))
    if keep_last is None:
        return merged
    newest = Window.partitionBy("channel_id").orderBy(F.desc("day"))
    return merged.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= keep_last).drop("_rn")


def catalogue_counts(videos: DataFrame) -> DataFrame:
    """Counts and publication range per channel and for the network (channel null)."""
    live = ~F.col("unavailable")
    return videos.rollup("channel_id").agg(
        F.count(F.lit(1)).alias("videos"), F.count_if(~F.col("is_short") & live).alias("long_form"),
        F.count_if(F.col("is_short") & live).alias("shorts"), F.count_if("unavailable").alias("unavailable"),
        F.count_if(F.col("unlisted") & live).alias("unlisted"),
        F.min("published_at").alias("oldest"), F.max("published_at").alias("newest"))


def reconcile_counts(videos: DataFrame, platform: DataFrame) -> DataFrame:
    """Channels where the platform counts fewer public videos than the catalogue; a zero count is no answer."""
    public = videos.groupBy("channel_id").agg(
        F.count_if(~F.col("unavailable") & ~F.col("unlisted")).alias("our_public"))
    return (platform.where("platform_count > 0").join(public, "channel_id")
            .where(F.col("platform_count") < F.col("our_public"))
            .withColumn("shortfall", F.col("our_public") - F.col("platform_count")))


# Status wording, in the order the rules are tried.
REASON_WORDING = [
    ("copyright", "copyright"),
    ("terms of service", "terms"),
    ("community guidelines", "guidelines"),
    ("account associated with this video has been terminated", "terminated"),
    ("removed by the uploader", "deleted"),
    ("isn't available anymore", "deleted"),
    ("no longer available", "deleted"),
    ("private", "private"),
]


def removal_reason(status: Column, reason: Column, detail: Column) -> Column:
    """Why a video is gone, from the player's status and wording; null if it cannot be told."""
    text = F.lower(F.concat_ws(" ", F.coalesce(reason, F.lit("")), F.coalesce(detail, F.lit(""))))
    out = F.when(status == "OK", "public")
    out = out.when((status == "LOGIN_REQUIRED") & text.contains("private"), "private")
    out = out.when(status == "LOGIN_REQUIRED", F.lit(None).cast("string"))
    for words, name in REASON_WORDING:
        out = out.when(text.contains(words), name)
    return out.when(status.isin("ERROR", "UNPLAYABLE"), "unavailable")


def copyright_claimant(detail: Column) -> Column:
    found = F.regexp_extract(detail, r"(?i)request by (.+?)[.\s]*$", 1)
    return F.when(F.length(found) > 0, F.trim(found))


def merge_reasons(store: DataFrame, videos: DataFrame, resolved: DataFrame, *, as_of: str,
                  refresh_days: int | None = None) -> DataFrame:
    """Next state of the removed-reason store.

    Only removed videos keep an entry; unlisted ones explain themselves; a known and
    fresh reason is kept, others take the newly resolved one if there is any.
    """
    now = F.lit(as_of).cast("timestamp")
    removed = videos.where(F.col("unavailable") | F.col("unlisted")).select("video_id", "unavailable", "unlisted")
    j = (removed.join(store.select("video_id", F.col("reason").alias("old"), F.col("detail").alias("old_detail"),
                                   F.col("checked").alias("old_checked")), "video_id", "left")
         .join(resolved.select("video_id", F.col("reason").alias("new"), F.col("detail").alias("new_detail")),
               "video_id", "left"))
    stale = F.lit(False) if refresh_days is None else (
        F.col("old_checked").isNull() | (F.unix_seconds(now) - F.unix_seconds("old_checked") >= refresh_days * 86400))
    only_unlisted = F.col("unlisted") & ~F.col("unavailable")
    known = F.coalesce((F.col("old") != "unavailable") & ~stale, F.lit(False))
    action = (F.when(only_unlisted & (F.col("old") == "unlisted"), "keep").when(only_unlisted, "unlisted")
              .when(known | F.col("new").isNull(), "keep").when(F.col("new") == "public", "drop").otherwise("take"))
    j = j.withColumn("action", action)

    def choose(new: Column, unlisted: Column, old: str) -> Column:
        return F.when(F.col("action") == "take", new).when(F.col("action") == "unlisted", unlisted).otherwise(F.col(old))

    return (j.where("action <> 'drop'")
            .select("video_id", choose(F.col("new"), F.lit("unlisted"), "old").alias("reason"),
                    choose(F.col("new_detail"), F.lit(None), "old_detail").alias("detail"),
                    choose(now, now, "old_checked").alias("checked"))
            .where("reason IS NOT NULL"))


def removed_list(videos: DataFrame, reasons: DataFrame) -> DataFrame:
    """Removed and unlisted videos with last-known views, reason and the strike alert."""
    return (videos.where(F.col("unavailable") | F.col("unlisted"))
            .join(reasons.select("video_id", "reason"), "video_id", "left")
            .select("video_id", "channel_id", "views", F.coalesce("reason", F.lit("unknown")).alias("reason"),
                    F.coalesce(F.col("reason") == "guidelines", F.lit(False)).alias("strike_alert")))


def refresh_associates(stored: DataFrame, listing: DataFrame, *, since: str) -> DataFrame:
    """Listed titles and dates win, new ids get empty figures; marks which rows need a stats refresh."""
    new = listing.select("video_id", F.col("title").alias("n_title"), F.col("published_at").alias("n_pub"),
                         F.col("channel_id").alias("n_ch"))
    j = stored.join(new, "video_id", "full")
    pub = F.coalesce("n_pub", "published_at")
    length = F.coalesce("duration_sec", F.lit(0))
    return j.select(
        "video_id", F.coalesce("channel_id", "n_ch").alias("channel_id"), F.coalesce("n_title", "title").alias("title"),
        pub.alias("published_at"), length.alias("duration_sec"), F.coalesce("views", F.lit(0)).alias("views"),
        ((pub >= F.lit(since).cast("timestamp")) | (length == 0)).alias("refresh"))


def transcript_index(attempts: DataFrame) -> DataFrame:
    """Latest outcome per video: fetched with its sizes, or failed with the error.

    `attempts` holds (video_id, at, ok, error, segments); a success is final.
    """
    ok = F.col("ok")
    text = F.array_join(F.transform("segments", lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    rows = attempts.withColumn("chars", F.when(ok, F.length(text))).withColumn("n_seg", F.when(ok, F.size("segments")))
    return rows.groupBy("video_id").agg(
        F.when(F.bool_or(ok), "fetched").otherwise("failed").alias("status"),
        F.max_by("n_seg", F.when(ok, F.col("at"))).cast("bigint").alias("segment_count"),
        F.max_by("chars", F.when(ok, F.col("at"))).cast("bigint").alias("char_count"),
        F.when(~F.bool_or(ok), F.max_by("error", "at")).alias("error"))


def failure_streaks(attempts: DataFrame, *, limit: int = 20) -> DataFrame:
    """Runs that hit `limit` failures in a row; uploader-disabled captions neither count nor reset."""
    disabled = F.coalesce(F.lower("error").contains("disabled on this video"), F.lit(False))
    counted = attempts.where(F.col("ok") | ~disabled)
    return (streaks(counted, "run_id", "attempt", ~F.col("ok"))
            .where(F.col("streak") >= limit).groupBy("run_id")
            .agg(F.min("attempt").alias("bail_attempt"), F.max("streak").alias("longest")))
