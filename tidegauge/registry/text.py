"""Text function, topic and story queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import text as X
from tidegauge.plans import stories as ST
from tidegauge.plans import topics as TP
from tidegauge.registry.base import query, sql
from tidegauge.session import cut_lineage
from tidegauge.sources import tables as T

QUERIES: dict = {}
ORACLE: dict = {}

# ---- SQL twins of the text functions ----


def slug_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g')"


def key_ctes(src: str, id_cols: str, name: str, prefix: str) -> dict[str, str]:
    """CTEs computing the name key of `name` for each row of `src`, ending in <prefix>_keys."""
    nums = " ".join(f"WHEN '{w}' THEN '{d}'" for w, d in X.NUMBER_WORDS.items())
    return {
        f"{prefix}_k1": f"""SELECT *, regexp_replace(trim(regexp_replace(replace(strip_accents(lower({name})), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '^the (\\S)', '\\1') AS t1 FROM {src}""",
        f"{prefix}_k2": f"""SELECT *, string_split(regexp_replace(array_to_string(list_transform(string_split(t1, ' '), lambda w: CASE w {nums} ELSE w END), ' '),
  '^(\\S+(?: \\S+)*?)(?: (?:case|saga))+$', '\\1'), ' ') AS w FROM {prefix}_k1""",
        f"{prefix}_keys": f"""SELECT {id_cols}, CASE WHEN len(w) >= 3 THEN array_to_string(list_concat(list_concat([w[1]],
  list_filter(w[2:len(w)-1], lambda x: length(x) > 1)), [w[-1]]), ' ') ELSE array_to_string(w, ' ') END AS key FROM {prefix}_k2""",
    }


def topic_name(k: str) -> str:
    """Five spellings of one subject name per five consecutive ids; valid in both SQL dialects."""
    d = f"(CAST(floor(({k}) / 5) AS BIGINT) % 10)"
    g = f"CAST(floor(({k}) / 5) AS BIGINT)"
    words = " ".join(f"WHEN {i} THEN '{w.capitalize()}'" for i, w in enumerate(X.NUMBER_WORDS))
    return (f"(CASE ({k}) % 5 WHEN 0 THEN concat({d} + 1, ' Widget ', {g}, ' affair') WHEN 1 THEN concat('The ', {d} + 1, ' widget ', {g}, ' Affair') "
            f"WHEN 2 THEN concat({d} + 1, ', WIDGET ', {g}, ' affair saga') WHEN 3 THEN concat(CASE {d} {words} END, ' widget ', {g}, ' affair case') "
            f"ELSE concat({d} + 1, ' Widget x ', {g}, ' affair') END)")


# ---- scalar text functions ----
@query(QUERIES, "fn9_story_tokens")
def fn9(spark, sf):
    v = T.text_videos(spark, sf)
    return v.select("video_id", F.posexplode(X.story_tokens(F.col("description"))).alias("pos", "token")) \
        .select("video_id", F.col("pos").cast("bigint").alias("pos"), "token")


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


def _toks(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({text}), 'https?://\\S+', ' ', 'g'), '[^a-z\\s'']', ' ', 'g'), '\\s+'), "
            f"lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t))")


_TOK_WHOLE = f"SELECT *, {_toks('description')} AS t FROM text_videos"
ORACLE["fn9_story_tokens"] = sql("""
SELECT video_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS token FROM toks""", "text_videos", toks=_TOK_WHOLE)


@query(QUERIES, "fn10_bigrams")
def fn10(spark, sf):
    """Bigram counts over the whole descriptions."""
    v = T.text_videos(spark, sf)
    tokens = X.story_tokens(F.col("description"), opener_chars=None)
    grams = X.bigrams(F.col("tokens"))
    return v.select("channel_id", tokens.alias("tokens")).select("channel_id", F.explode(grams).alias("bigram")).groupBy("channel_id", "bigram").agg(F.count(F.lit(1)).alias("n"))


ORACLE["fn10_bigrams"] = sql("""
SELECT channel_id, bigram, count(*) AS n FROM (
  SELECT channel_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1])) AS bigram FROM toks) b
GROUP BY channel_id, bigram""", "text_videos", toks=_TOK_WHOLE)


@query(QUERIES, "fn11_speech_tokens")
def fn11(spark, sf):
    t = T.transcripts(spark, sf)
    words = X.speech_tokens(F.array_join(F.transform("segments", lambda s: s["text"]), " "))
    return t.select("channel_id", F.explode(words).alias("word")).groupBy("channel_id", "word").agg(F.count(F.lit(1)).alias("n"))


SPEECH_TOKS = """list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(replace(text, chr(10), ' ')), '\\[[^\\]]*\\]', ' ', 'g'),
 '[^a-z0-9'' ]+', ' ', 'g'), '\\s+'), lambda t: length(t) > 0)"""
ORACLE["fn11_speech_tokens"] = f"""
SELECT source AS channel_id, word, count(*) AS n FROM (SELECT source, unnest({SPEECH_TOKS}) AS word FROM documents) x GROUP BY source, word"""


@query(QUERIES, "fn13_phrase_key")
def fn13(spark, sf):
    return T.text_videos(spark, sf).select("video_id", X.phrase_key(F.col("title")).alias("phrase"))


ORACLE["fn13_phrase_key"] = sql("""
SELECT video_id, ' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ' AS phrase FROM text_videos""", "text_videos")


@query(QUERIES, "fn14_slug")
def fn14(spark, sf):
    return T.text_videos(spark, sf).select("video_id", X.slug(F.col("title")).alias("slug"))


ORACLE["fn14_slug"] = sql(f"SELECT video_id, {slug_sql('title')} AS slug FROM text_videos", "text_videos")


@query(QUERIES, "fn15_name_key")
def fn15(spark, sf):
    names = T.table(spark, sf, "part").select("p_partkey", F.expr(topic_name("p_partkey")).alias("name"))
    titles = T.text_videos(spark, sf).select((-F.col("video_id") - 1).alias("p_partkey"), F.col("title").alias("name"))
    return names.unionByName(titles).select("p_partkey", X.name_key(F.col("name")).alias("key"))


ORACLE["fn15_name_key"] = sql("SELECT p_partkey, key FROM n_keys", "text_videos",
                              names=f"""SELECT p_partkey, {topic_name('p_partkey')} AS name FROM part
UNION ALL SELECT -video_id - 1, title FROM text_videos""", **key_ctes("names", "p_partkey", "name", "n"))


def _colour_ctes(src: str, id_col: str, name: str) -> dict[str, str]:
    def ch(n: int) -> str:
        k = f"fmod({n}::DOUBLE + hue * 12, 12)"
        return f"lpad(lower(to_hex(CAST(floor(255 * (0.56::DOUBLE - {0.6 * min(0.56, 1 - 0.56)!r}::DOUBLE * greatest(-1::DOUBLE, least({k} - 3, 9 - {k}, 1::DOUBLE))) + 0.5) AS BIGINT))), 2, '0')"
    return {
        "hues": f"""SELECT {id_col}, {name}, (list_reduce(list_prepend(0::BIGINT, list_transform(string_split({name}, ''), lambda c: unicode(c)::BIGINT)),
  lambda h, c: (h * 31 + c) % 4294967296) % 360) / 360.0::DOUBLE AS hue FROM {src}""",
        "colours": f"SELECT {id_col}, {name}, '#' || {ch(0)} || {ch(8)} || {ch(4)} AS colour FROM hues",
    }


@query(QUERIES, "fn16_name_colour")
def fn16(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", X.name_colour(F.expr(topic_name("p_partkey"))).alias("colour"))


ORACLE["fn16_name_colour"] = sql("SELECT p_partkey, colour FROM colours", names=f"SELECT p_partkey, {topic_name('p_partkey')} AS name FROM part",
                                 **_colour_ctes("names", "p_partkey", "name"))

_LINKS = ("concat('see https://youtu.be/', substring(md5(cast(page_id as varchar(20))), 1, 11), ' and ', url, ' also youtube.com/watch?v=', "
          "substring(md5(cast(page_id + 1 as varchar(20))), 1, 11), '&t=3 pic i.ytimg.com/vi/', substring(md5(cast(page_id as varchar(20))), 1, 11), '/hq.jpg ', html)")


@query(QUERIES, "fn17_video_ids")
def fn17(spark, sf):
    text = F.expr(_LINKS)
    return T.table(spark, sf, "pages").select("page_id", F.explode(X.video_ids(text)).alias("video_id"))


ORACLE["fn17_video_ids"] = f"""
SELECT DISTINCT page_id, unnest(list_concat(list_concat(regexp_extract_all(x, 'i\\.ytimg\\.com/vi/([A-Za-z0-9_-]{{11}})/', 1),
  regexp_extract_all(x, 'youtube\\.com/(?:embed/|watch\\?v=)([A-Za-z0-9_-]{{11}})', 1)), regexp_extract_all(x, 'youtu\\.be/([A-Za-z0-9_-]{{11}})', 1))) AS video_id
FROM (SELECT page_id, {_LINKS} AS x FROM pages) p"""


@query(QUERIES, "fn18_snippets")
def fn18(spark, sf):
    return T.text_videos(spark, sf).select("video_id", X.snippet(F.col("description")).alias("snippet"),
                                           X.first_line(F.col("description")).alias("first_line"))


ORACLE["fn18_snippets"] = sql("""
SELECT video_id, CASE WHEN length(line) > 260 THEN substring(line, 1, 260) || '…' ELSE line END AS snippet, substring(title, 1, 120) AS first_line
FROM (SELECT *, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS line FROM text_videos) x""", "text_videos")

_PROTO = """concat('{"1": [{"2": "', cast(event_id as varchar(20)), '", "6": {"1": "', cast(1704067200 + event_id as varchar(20)), '"}, "3": {"1": {"4": "p', cast(user_id as varchar(20)), '"}}}], "was": ', props, '}')"""


@query(QUERIES, "fn20_json_paths")
def fn20(spark, sf):
    doc = F.expr(_PROTO)
    return T.table(spark, sf, "events").select(
        "event_id", F.get_json_object(doc, "$.1[0].2").alias("creative_id"),
        F.get_json_object(doc, "$.1[0].6.1").cast("bigint").alias("first_sec"),
        F.coalesce(F.get_json_object(doc, "$.1[0].3.9.4"), F.get_json_object(doc, "$.1[0].3.1.4")).alias("preview"),
        F.get_json_object(doc, "$.was.k").cast("bigint").alias("k"))


ORACLE["fn20_json_paths"] = f"""
SELECT event_id, json_extract_string(j, '$."1"[0]."2"') AS creative_id, CAST(json_extract_string(j, '$."1"[0]."6"."1"') AS BIGINT) AS first_sec,
       json_extract_string(j, '$."1"[0]."3"."1"."4"') AS preview, CAST(json_extract_string(j, '$.was.k') AS BIGINT) AS k
FROM (SELECT event_id, {_PROTO} AS j FROM events) x"""


@query(QUERIES, "fn21_content_hash")
def fn21(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.left(F.sha2("text", 256), F.lit(16)).alias("hash"))


ORACLE["fn21_content_hash"] = "SELECT doc_id, left(sha256(text), 16) AS hash FROM documents"

# ---- keyword tagging ----
# The taxonomy is a table: one topic for each brand and type of `part`, its keywords made of two syllables of the invented
# prose, and a few hand-kept topics, among them a format topic, one that must be skipped and one without keywords.
_FIRST = "the of de and to en la is que le it for as die ou re an with ch des und by es et ai tion at st".split()
_SECOND = "ci in a der that on n er was be r this are from les th un eau el nd ha ment oi rewh den".split()
_HAND = {"english": ["the", "and", "of the"], "french": ["que", "les", "de la"], "german": ["nicht", "und", "der"],
         "spanish": ["para", "del", "los", "los"], "livestream": ["in", "re", "a"], "edges": ["c++", "#ou", "é ou", "ou é", "r."],
         "_draft": ["the"], "empty": [None]}
_PHRASE = ("concat(element_at({first}, CAST(p_partkey % " + str(len(_FIRST)) + " + 1 AS INT)), ' ', "
           "element_at({second}, CAST(p_size % " + str(len(_SECOND)) + " + 1 AS INT)))")


def _taxonomy(spark, sf):
    words = {"first": f"array({', '.join(map(repr, _FIRST))})", "second": f"array({', '.join(map(repr, _SECOND))})"}
    drawn = T.table(spark, sf, "part").select(F.expr("lower(concat(p_brand, '-', p_type))").alias("topic_id"),
                                              F.expr(_PHRASE.format(**words)).alias("keyword")).distinct()
    hand = spark.createDataFrame([(t, k) for t, ks in _HAND.items() for k in ks], "topic_id string, keyword string")
    return drawn.unionByName(hand)


def _texts(spark, sf):
    spoken = T.transcripts(spark, sf).select("video_id", F.array_join(F.transform("segments", lambda s: s["text"]), " ").alias("transcript"))
    return T.text_videos(spark, sf).select("video_id", "title", "description"), spoken


_DUCK_PHRASE = _PHRASE.replace("element_at(", "list_extract(").format(first=repr(_FIRST), second=repr(_SECOND))
_TAGGING = {
    "taxonomy": f"""
SELECT DISTINCT lower(concat(p_brand, '-', p_type)) AS topic_id, {_DUCK_PHRASE} AS keyword FROM part
UNION ALL SELECT * FROM (VALUES {", ".join(f"('{t}', '{k}')" for t, ks in _HAND.items() for k in ks if k and not t.startswith("_"))}) h(topic_id, keyword)""",
    # runs of word characters and of others, in order; a keyword of up to three runs is met by runs that are equal
    "sides": """
SELECT video_id, 'title' AS side, lower(title) AS x FROM text_videos
UNION ALL SELECT video_id, 'description', lower(description) FROM text_videos
UNION ALL SELECT video_id, 'transcript', replace(lower(description), chr(10), ' ') FROM text_videos""",
    "runs": """
SELECT video_id, side, i, r[i] AS r1, r[i + 1] AS r2, r[i + 2] AS r3, len(r) AS n
FROM (SELECT video_id, side, r, unnest(range(1, len(r) + 1)) AS i
      FROM (SELECT video_id, side, regexp_extract_all(x, '[a-z0-9_A-Z]+|[^a-z0-9_A-Z]+') AS r FROM sides) a) b""",
    "cut": """
SELECT topic_id, keyword, len(r) AS m, r[1] AS k1, r[2] AS k2, r[3] AS k3, regexp_matches(r[1], '^[a-z0-9_]') AS opens, regexp_matches(r[-1], '[a-z0-9_]$') AS closes
FROM (SELECT topic_id, keyword, regexp_extract_all(keyword, '[a-z0-9_]+|[^a-z0-9_]+') AS r FROM taxonomy) t""",
    "met": """
SELECT video_id, topic_id, side FROM runs JOIN cut ON r1 = k1
WHERE (m < 2 OR r2 = k2) AND (m < 3 OR r3 = k3) AND (opens OR i > 1) AND (closes OR i + m - 1 < n)""",
    "scored": """
SELECT video_id, topic_id, 3.0::DOUBLE * count(*) FILTER (WHERE side = 'title') AS title_score,
       3.0::DOUBLE * count(*) FILTER (WHERE side = 'title') + 1.5::DOUBLE * count(*) FILTER (WHERE side = 'description') + count(*) FILTER (WHERE side = 'transcript') AS total_score
FROM met GROUP BY video_id, topic_id""",
    "picked": """
SELECT video_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY topic_id = 'livestream', title_score DESC, total_score DESC, topic_id) AS rk
 FROM scored WHERE total_score >= 3) s WHERE rk = 1""",
    "tagged": """
SELECT t.video_id, CASE WHEN t.video_id % 31 = 0 THEN NULL WHEN t.video_id % 37 = 0 THEN 'german' ELSE p.topic_id END AS topic_id,
       CASE WHEN t.video_id % 31 = 0 THEN p.topic_id IS NOT NULL WHEN t.video_id % 37 = 0 THEN p.topic_id IS DISTINCT FROM 'german' ELSE FALSE END AS overridden
FROM text_videos t LEFT JOIN picked p USING (video_id)""",
}


def _tagged(spark, sf):
    key = F.col("video_id")
    forced = F.when(key % 31 == 0, F.lit(None).cast("string")).when(key % 37 == 0, "german").otherwise("no-such-topic")
    overrides = T.text_videos(spark, sf).where((key % 31 == 0) | (key % 37 == 0) | (key % 41 == 0)).select("video_id", forced.alias("topic_id"))
    written, spoken = _texts(spark, sf)
    taxonomy = _taxonomy(spark, sf)
    return TP.tag_videos(written, TP.pick_topic(TP.topic_scores(written, spoken, taxonomy)), overrides, taxonomy)


@query(QUERIES, "fn12_topic_scores")
def fn12(spark, sf):
    return TP.topic_scores(*_texts(spark, sf), _taxonomy(spark, sf))


ORACLE["fn12_topic_scores"] = sql("SELECT * FROM scored", "text_videos", **{k: _TAGGING[k] for k in ("taxonomy", "sides", "runs", "cut", "met", "scored")})


@query(QUERIES, "dp20_topic_tags")
def dp20(spark, sf):
    return _tagged(spark, sf)


ORACLE["dp20_topic_tags"] = sql("SELECT * FROM tagged", "text_videos", **_TAGGING)


@query(QUERIES, "dp20_topic_counts")
def dp20_counts(spark, sf):
    return TP.tag_counts(_tagged(spark, sf))


ORACLE["dp20_topic_counts"] = sql("SELECT topic_id, count(*) AS videos FROM tagged WHERE topic_id IS NOT NULL GROUP BY topic_id",
                                  "text_videos", **_TAGGING)


@query(QUERIES, "dp20_tag_stats")
def dp20_stats(spark, sf):
    return TP.tag_stats(_tagged(spark, sf))


ORACLE["dp20_tag_stats"] = sql("""
SELECT count(topic_id) AS tagged, count(*) - count(topic_id) AS untagged, count(*) AS targets, count(*) FILTER (WHERE overridden) AS overridden
FROM tagged""", "text_videos", **_TAGGING)

# ---- stories ----


def _story(spark, sf, opener=None):
    v = T.text_videos(spark, sf)
    postings = ST.term_postings(v, as_of="2024-03-01 00:00:00", opener_chars=opener)
    sizes = ST.pool_sizes(ST.story_pool(v, as_of="2024-03-01 00:00:00"))
    return v, postings, sizes


_POST = """
SELECT channel_id, video_id, published_at >= TIMESTAMP '2024-03-01' - INTERVAL 7 DAY AS is_recent,
       unnest(list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1])))) AS term
FROM toks WHERE published_at >= TIMESTAMP '2024-03-01' - INTERVAL 60 DAY AND length(description) > 0"""
_SPIKE = {
    "postings": _POST,
    "sizes": """
SELECT channel_id, count(*) FILTER (WHERE r) AS recent_total, count(*) FILTER (WHERE NOT r) AS base_total
FROM (SELECT channel_id, published_at >= TIMESTAMP '2024-03-01' - INTERVAL 7 DAY AS r FROM text_videos
      WHERE published_at >= TIMESTAMP '2024-03-01' - INTERVAL 60 DAY AND length(description) > 0) x
GROUP BY channel_id HAVING count(*) FILTER (WHERE r) >= 3""",
    "spikes": """
SELECT channel_id, term, recent, base, ratio FROM (
  SELECT *, (recent / recent_total) / ((base + 0.5::DOUBLE) / (base_total + 1)) AS ratio
  FROM (SELECT channel_id, term, count(*) FILTER (WHERE is_recent) AS recent, count(*) FILTER (WHERE NOT is_recent) AS base
        FROM postings GROUP BY channel_id, term) c JOIN sizes USING (channel_id) WHERE recent >= 3) s WHERE ratio >= 3""",
}


@query(QUERIES, "dp21_term_spikes_whole_text")
def dp21_whole(spark, sf):
    _, postings, sizes, _ = _spiking(spark, sf)
    return ST.term_spikes(postings, sizes).withColumn("ratio", F.round("ratio", 6))


ORACLE["dp21_term_spikes_whole_text"] = sql("SELECT * REPLACE (round(ratio, 6) AS ratio) FROM spikes", "text_videos", toks=_TOK_WHOLE, **_SPIKE)


def _spiking(spark, sf):
    """As `_story`, but only the postings of terms that can spike; then all postings of recent videos."""
    v, _, sizes = _story(spark, sf)
    recent = ST.recent_postings(v, as_of="2024-03-01 00:00:00")
    return v, ST.frequent_postings(v, recent, as_of="2024-03-01 00:00:00"), sizes, recent


def _all_clusters(spark, sf, *, baseline=False):
    """All clusters and the postings of their terms, then those of all recent videos.

    Baseline videos are only counted, unless `baseline` asks for their postings too.
    """
    v, postings, sizes, recent = _spiking(spark, sf)
    if baseline:
        postings = cut_lineage(postings)  # narrow rows; texts are not read again
    spikes = cut_lineage(ST.term_spikes(postings, sizes))
    mine = cut_lineage(ST.spiking_postings(postings if baseline else recent, spikes))
    return v, mine, sizes, ST.cluster_terms(spikes, mine), recent


def _clusters(spark, sf, *, baseline=False):
    """The published clusters."""
    v, mine, sizes, clusters, recent = _all_clusters(spark, sf, baseline=baseline)
    return v, mine, sizes, ST.published(clusters), recent


def _cluster_ctes() -> dict[str, str]:
    return {
        "rec": "SELECT channel_id, term, video_id FROM postings SEMI JOIN spikes USING (channel_id, term) WHERE is_recent",
        "close": """
SELECT channel_id, a, b FROM (
  SELECT x.channel_id, x.term AS a, y.term AS b, count(*) AS n FROM rec x JOIN rec y ON y.channel_id = x.channel_id AND y.video_id = x.video_id GROUP BY ALL) p
JOIN (SELECT channel_id, term AS a, recent AS na FROM spikes) s USING (channel_id, a) JOIN (SELECT channel_id, term AS b, recent AS nb FROM spikes) t USING (channel_id, b)
WHERE n / (na + nb - n) >= 0.35::DOUBLE""",
        # one seed of each channel after the other, until no term is left
        "greedy": """
SELECT channel_id, term, recent, base, ratio, 0::BIGINT AS step, NULL::BIGINT AS cluster, NULL::VARCHAR AS seed FROM spikes
UNION ALL
SELECT g.channel_id, term, recent, base, ratio, step + 1, CASE WHEN c.b IS NOT NULL THEN step + 1 END, g.s
FROM (SELECT *, first_value(term) OVER (PARTITION BY channel_id ORDER BY ratio DESC, term) AS s FROM greedy WHERE cluster IS NULL) g
LEFT JOIN close c ON c.channel_id = g.channel_id AND c.a = g.s AND c.b = g.term""",
        "every": "SELECT channel_id, cluster, seed, term, recent, base, ratio FROM greedy WHERE cluster IS NOT NULL",
        "clusters": "SELECT * FROM every WHERE cluster <= 6",
        "cvideos": "SELECT DISTINCT channel_id, cluster, video_id, is_recent FROM postings JOIN clusters USING (channel_id, term)",
        "stats": """
SELECT *, saturation / base_saturation AS ratio FROM (
  SELECT m.*, l.label, l.terms, s.recent_total, s.base_total, m.recent / s.recent_total AS saturation, (m.base + 0.5::DOUBLE) / (s.base_total + 1) AS base_saturation
  FROM (SELECT channel_id, cluster, count(*) FILTER (WHERE is_recent) AS recent, count(*) FILTER (WHERE NOT is_recent) AS base FROM cvideos GROUP BY ALL) m
  JOIN (SELECT channel_id, cluster, count(*) AS terms, min(struct_pack(a := -recent, b := -ratio, term := term)).term AS label
        FROM clusters GROUP BY ALL) l USING (channel_id, cluster) JOIN sizes s USING (channel_id)) q""",
    }


_CL = _cluster_ctes()
_CLUSTER_SQL = {"toks": _TOK_WHOLE, **_SPIKE, **_CL}


@query(QUERIES, "dp22_term_clusters")
def dp22(spark, sf):
    return _all_clusters(spark, sf)[3].select("channel_id", "cluster", "seed", "term", "recent")


ORACLE["dp22_term_clusters"] = sql("SELECT channel_id, cluster, seed, term, recent FROM every", "text_videos", **_CLUSTER_SQL)


@query(QUERIES, "dp22_unpublished")
def dp22_rest(spark, sf):
    return ST.unpublished(_all_clusters(spark, sf)[3])


ORACLE["dp22_unpublished"] = sql("""
SELECT channel_id, count(DISTINCT cluster) AS clusters, count(*) AS terms, min(struct_pack(r := -ratio, t := term)).t AS strongest
FROM every WHERE cluster > 6 GROUP BY channel_id""", "text_videos", **_CLUSTER_SQL)


@query(QUERIES, "dp22_cluster_stats")
def dp22_stats(spark, sf):
    _, postings, sizes, clusters, _ = _clusters(spark, sf, baseline=True)
    return ST.cluster_stats(clusters, postings, sizes).select(
        "channel_id", "cluster", "label", "terms", "recent", "base", F.round("ratio", 6).alias("ratio"))


ORACLE["dp22_cluster_stats"] = sql("""
SELECT channel_id, cluster, label, terms, recent, base, round(ratio, 6) AS ratio FROM stats""", "text_videos", **_CLUSTER_SQL)


@query(QUERIES, "dp22_shown_terms")
def dp22_shown(spark, sf):
    return ST.shown_terms(_clusters(spark, sf)[3]).select("channel_id", "cluster", "term", F.col("position").cast("bigint").alias("position"))


ORACLE["dp22_shown_terms"] = sql("""
SELECT channel_id, cluster, term, position FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, cluster
  ORDER BY len(string_split(term, ' ')), recent DESC, ratio DESC, term) AS position FROM clusters) s WHERE position <= 8""", "text_videos", **_CLUSTER_SQL)


def _labels(postings):
    """Display names for the words that can spike: every term of five letters or fewer."""
    return postings.where(F.length("term") <= 5).select(F.col("term").alias("term_id")).distinct().withColumn(
        "display_name", F.concat(F.lit("Story: "), "term_id"))


@query(QUERIES, "dp23_trackers")
def dp23(spark, sf):
    _, postings, sizes, clusters, _ = _clusters(spark, sf, baseline=True)
    return ST.trackers(ST.cluster_stats(clusters, postings, sizes), _labels(postings))


ORACLE["dp23_trackers"] = sql("""
SELECT channel_id, cluster, label AS term_id, CASE WHEN length(label) <= 5 THEN 'Story: ' || label ELSE label END AS name,
       round(saturation, 4) AS recent_saturation, round(base_saturation, 4) AS base_saturation, round(ratio, 2) AS spike_ratio, recent, base
FROM stats WHERE saturation >= 0.30::DOUBLE""", "text_videos", **_CLUSTER_SQL)


@query(QUERIES, "dp23_tracker_keywords")
def dp23_kw(spark, sf):
    return ST.tracker_keywords(_clusters(spark, sf)[3]).select("channel_id", "cluster", "term", F.col("position").cast("bigint").alias("position"))


ORACLE["dp23_tracker_keywords"] = sql("""
SELECT channel_id, cluster, term, position FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, cluster
  ORDER BY term <> seed, ratio DESC, term) AS position FROM clusters) s WHERE position <= 12""", "text_videos", **_CLUSTER_SQL)


@query(QUERIES, "dp24_sample_videos")
def dp24(spark, sf):
    v, postings, _, clusters, _ = _clusters(spark, sf)
    return ST.sample_videos(clusters, postings, v).select("channel_id", "cluster", "video_id", F.col("position").cast("bigint").alias("position"))


ORACLE["dp24_sample_videos"] = sql("""
SELECT channel_id, cluster, video_id, position FROM (
  SELECT c.channel_id, c.cluster, c.video_id, row_number() OVER (PARTITION BY c.channel_id, c.cluster ORDER BY v.published_at DESC, c.video_id) AS position
  FROM cvideos c JOIN text_videos v USING (video_id) WHERE c.is_recent) s WHERE position <= 5""", "text_videos", **_CLUSTER_SQL)


def _manual_keywords(spark, sf):
    """A hand-kept tracker per channel: its terms of four letters."""
    _, postings, _ = _story(spark, sf, opener=None)
    return postings.where(F.length("term") == 4).select("channel_id", F.lit("short words").alias("tracker"), F.col("term").alias("keyword")).distinct()


_MANUAL = "SELECT DISTINCT channel_id, term FROM postings WHERE length(term) = 4"


@query(QUERIES, "dp46_tracker_saturation")
def dp46(spark, sf):
    _, postings, sizes = _story(spark, sf, opener=None)
    return ST.keyword_saturation(_manual_keywords(spark, sf), postings, sizes).select(
        "channel_id", "tracker", "recent", "base", F.round("saturation", 6).alias("saturation"))


ORACLE["dp46_tracker_saturation"] = sql("""
SELECT channel_id, 'short words' AS tracker, recent, base, round(recent / recent_total, 6) AS saturation
FROM (SELECT channel_id, count(DISTINCT CASE WHEN is_recent THEN video_id END) AS recent, count(DISTINCT CASE WHEN NOT is_recent THEN video_id END) AS base
      FROM postings SEMI JOIN manual USING (channel_id, term) GROUP BY channel_id) m JOIN sizes USING (channel_id)""",
    "text_videos", toks=_TOK_WHOLE, **_SPIKE, manual=_MANUAL)


@query(QUERIES, "dp46_suppressed_clusters")
def dp46_suppressed(spark, sf):
    _, mine, _, clusters, postings = _clusters(spark, sf)
    manual = postings.where(F.length("term") == 4).select(
        "channel_id", F.lit("short words").alias("tracker"), F.col("term").alias("keyword")).distinct()
    return ST.suppressed_clusters(ST.cluster_videos(clusters, mine), manual, postings, overlap=0.2)


ORACLE["dp46_suppressed_clusters"] = sql("""
SELECT channel_id, cluster, 'short words' AS tracker, round(b / (a + m - b), 4) AS jaccard FROM (
  SELECT channel_id, cluster, count(*) AS a, count(mv.video_id) AS b, any_value(t.m) AS m
  FROM (SELECT * FROM cvideos WHERE is_recent) c LEFT JOIN mv USING (channel_id, video_id) JOIN (SELECT channel_id, count(*) AS m FROM mv GROUP BY channel_id) t USING (channel_id)
  GROUP BY channel_id, cluster) j WHERE b / (a + m - b) >= 0.2::DOUBLE""", "text_videos", **_CLUSTER_SQL, manual=_MANUAL,
    mv="SELECT DISTINCT channel_id, video_id FROM postings SEMI JOIN manual USING (channel_id, term) WHERE is_recent")


@query(QUERIES, "jn13_term_overlap")
def jn13(spark, sf):
    """Jaccard of each spiking term's recent videos with its channel's strongest term."""
    _, postings, _, clusters, _ = _all_clusters(spark, sf)
    recent = ST.spiking_postings(postings, clusters).where("is_recent")
    first = clusters.where("cluster = 1").select("channel_id", "seed").distinct()
    seed = recent.join(first.withColumnRenamed("seed", "term"), ["channel_id", "term"]).select("channel_id", "video_id")
    size = seed.groupBy("channel_id").agg(F.count(F.lit(1)).alias("seed_n"))
    spikes = recent.groupBy("channel_id", "term").agg(F.count(F.lit(1)).alias("recent"))
    both = (recent.join(spikes, ["channel_id", "term"]).join(seed, ["channel_id", "video_id"])
            .groupBy("channel_id", "term", "recent").agg(F.count(F.lit(1)).alias("both")))
    return both.join(size, "channel_id").select(
        "channel_id", "term", F.round(F.col("both") / (F.col("recent") + F.col("seed_n") - F.col("both")), 6).alias("jaccard"))


ORACLE["jn13_term_overlap"] = sql("""
SELECT l.channel_id, l.term, round(x.b / (l.recent + s.seed_n - x.b), 6) AS jaccard FROM spikes l JOIN seed1 s USING (channel_id)
JOIN (SELECT a.channel_id, a.term, count(*) AS b FROM rec a JOIN seed1 s ON s.channel_id = a.channel_id
      JOIN rec v ON v.channel_id = s.channel_id AND v.term = s.seed AND v.video_id = a.video_id GROUP BY ALL) x
  ON x.channel_id = l.channel_id AND x.term = l.term""", "text_videos", toks=_TOK_WHOLE, **_SPIKE, rec=_CL["rec"],
    seed1="SELECT channel_id, s.term AS seed, s.n AS seed_n FROM (SELECT channel_id, min(struct_pack(r := -ratio, term := term, n := recent)) AS s FROM spikes GROUP BY channel_id) x")
