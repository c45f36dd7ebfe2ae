"""Declared schemas of the documents the readers accept; nothing is inferred."""

from pyspark.sql import types as T

COUNTER = T.LongType()

VIDEO = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("channelId", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("publishedAt", T.StringType()), T.StructField("durationSec", T.LongType()),
    T.StructField("views", COUNTER), T.StructField("likes", COUNTER), T.StructField("comments", COUNTER),
    T.StructField("isShort", T.BooleanType()), T.StructField("unavailable", T.BooleanType()),
    T.StructField("unavailableSince", T.StringType()), T.StructField("unlisted", T.BooleanType()),
    T.StructField("unlistedSince", T.StringType()), T.StructField("ageH", T.DoubleType())])

CHANNEL = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "handle", "title", "url")])

CATALOGUE = T.StructType([
    T.StructField("channels", T.MapType(T.StringType(), CHANNEL)), T.StructField("channel", T.MapType(T.StringType(), T.StringType())),
    T.StructField("meta", T.StructType([T.StructField("lastUpdated", T.StringType())])),
    T.StructField("t", T.StringType()), T.StructField("videos", T.ArrayType(VIDEO)),
    T.StructField("_corrupt_record", T.StringType())])

ROSTER = T.StructType([T.StructField("channels", T.MapType(T.StringType(), T.StructType([
    T.StructField("channelId", T.StringType()), T.StructField("videoIds", T.ArrayType(T.StringType()))])))])

CAMPAIGNS = T.StructType([T.StructField("videos", T.MapType(T.StringType(), T.StructType([
    T.StructField("windows", T.ArrayType(T.ArrayType(T.StringType())))])))])

SEGMENT = T.StructType([T.StructField("text", T.StringType()), T.StructField("offset", T.LongType()),
                        T.StructField("duration", T.LongType())])

TRANSCRIPT = T.StructType([
    T.StructField("videoId", T.StringType()), T.StructField("channelId", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("publishedAt", T.StringType()), T.StructField("segments", T.ArrayType(SEGMENT)),
    T.StructField("_corrupt_record", T.StringType())])

PRICE_HISTORY = T.StructType([T.StructField(n, T.StringType()) for n in
                              ("date", "time", "asin", "label", "available", "price", "status")])
