"""Speech and price queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.plans import prices as P
from tidegauge.plans import speech as SP
from tidegauge.registry.base import query, sql
from tidegauge.registry.text import SPEECH_TOKS
from tidegauge.session import cut_lineage
from tidegauge.sources import tables as T

QUERIES: dict = {}
ORACLE: dict = {}

# Frequent words of the invented prose stand in for fillers.
WORDS = {"hard": ["the", "que", "der"], "hedge_uni": ["of", "les", "und"],
         "hedge_bi": [("in", "the"), ("de", "la"), ("of", "a")], "ok_double": ["a", "re"]}


def _tally(spark, sf):
    return SP.filler_tally(T.transcripts(spark, sf), **WORDS)


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_BI = " OR ".join(f"({{a}} = '{a}' AND {{b}} = '{b}')" for a, b in WORDS["hedge_bi"])
_SPEECH = {
    "tok": f"""
SELECT doc_id, t, p, lag(t) OVER w AS prev, lead(t) OVER w AS nxt
FROM (SELECT doc_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS p FROM (SELECT doc_id, {SPEECH_TOKS} AS toks FROM documents) a WHERE len(toks) >= 50) b
WINDOW w AS (PARTITION BY doc_id ORDER BY p)""",
    "cnt": f"""
SELECT doc_id, count(*) AS words, count(*) FILTER (WHERE t IN ({_list(WORDS['hard'])})) AS hard, count(*) FILTER (WHERE t = prev) AS rep_all,
       count(*) FILTER (WHERE t = prev AND t NOT IN ({_list(WORDS['ok_double'])})) AS rep,
       count(*) FILTER (WHERE t IN ({_list(WORDS['hedge_uni'])})) + count(*) FILTER (WHERE {_BI.format(a='prev', b='t')}) AS hedge,
       count(*) FILTER (WHERE t IN ({_list(WORDS['hard'])}) OR t IN ({_list(WORDS['hedge_uni'])}) OR (t = prev AND t NOT IN ({_list(WORDS['ok_double'])}))
         OR {_BI.format(a='prev', b='t')} OR {_BI.format(a='t', b='nxt')}) AS filler_words
FROM tok GROUP BY doc_id""",
    "tally": """
SELECT c.doc_id AS video_id, d.source AS channel_id, DATE '2020-05-01' + CAST((c.doc_id*3) % 900 AS INTEGER) AS published_at,
       CAST(floor(dur + 0.5) AS BIGINT) AS duration_sec, words, round(words / (dur / 60), 1) AS wpm, hard, rep_all, rep, hedge, filler_words,
       round(hard / words * 100, 2) AS hard_per_100, round(rep / words * 100, 2) AS rep_per_100, round(hedge / words * 100, 2) AS hedge_per_100,
       round(filler_words / words * 100, 2) AS filler_per_100, round(hard / words * dur, 1) AS hard_sec, round(filler_words / words * dur, 1) AS filler_sec
FROM cnt c JOIN (SELECT *, ((len(string_split(text, chr(10))) - 1) * 60000 + 55000) / 1000.0::DOUBLE AS dur FROM documents) d USING (doc_id)""",
    "rows_in": """
SELECT *, strftime(published_at, '%Y-%m') AS month FROM tally WHERE duration_sec >= 300 AND strftime(published_at, '%Y-%m') >= '2020-08'""",
    "trend": """
SELECT month, count(*) AS videos, CAST(sum(words) AS BIGINT) AS words, round(sum(hard) / sum(words) * 100, 4) AS hard_per_100,
       round(sum(rep) / sum(words) * 100, 4) AS rep_per_100, round(sum(hedge) / sum(words) * 100, 4) AS hedge_per_100,
       round(sum(words) / (sum(duration_sec) / 60), 2) AS wpm FROM rows_in GROUP BY month""",
}


@query(QUERIES, "src10_transcript_scan")
def src10(spark, sf):
    return T.transcripts(spark, sf).select("video_id", SP.transcript_text(F.col("segments")).alias("text"),
                                           F.size("segments").cast("bigint").alias("segments"))


ORACLE["src10_transcript_scan"] = """
SELECT doc_id AS video_id, replace(text, chr(10), ' ') AS text, CAST(len(string_split(text, chr(10))) AS BIGINT) AS segments FROM documents"""


@query(QUERIES, "dp30_filler_tally")
def dp30(spark, sf):
    return _tally(spark, sf).drop("hard_tokens", "title", "published_at")


ORACLE["dp30_filler_tally"] = sql("SELECT * EXCLUDE (published_at) FROM tally", **{k: _SPEECH[k] for k in ("tok", "cnt", "tally")})


@query(QUERIES, "dp31_monthly_trend")
def dp31(spark, sf):
    return SP.monthly_trend(SP.qualifying(_tally(spark, sf)))


ORACLE["dp31_monthly_trend"] = sql("SELECT * FROM trend", **_SPEECH)


@query(QUERIES, "dp31_corpus_totals")
def dp31_totals(spark, sf):
    return SP.corpus_totals(SP.qualifying(_tally(spark, sf)))


ORACLE["dp31_corpus_totals"] = sql("""
SELECT videos, words, tally, n AS count, round(n / words * 100, 4) AS per_100, round(n / words * secs / 60, 2) AS minutes
FROM (SELECT videos, words, secs, unnest(['hard', 'rep_all', 'rep', 'hedge', 'filler_words']) AS tally, unnest([hard, rep_all, rep, hedge, filler]) AS n
      FROM (SELECT count(*) AS videos, CAST(sum(words) AS BIGINT) AS words, CAST(sum(duration_sec) AS BIGINT) AS secs, CAST(sum(hard) AS BIGINT) AS hard,
                   CAST(sum(rep_all) AS BIGINT) AS rep_all, CAST(sum(rep) AS BIGINT) AS rep, CAST(sum(hedge) AS BIGINT) AS hedge,
                   CAST(sum(filler_words) AS BIGINT) AS filler FROM rows_in) s) u""", **{k: v for k, v in _SPEECH.items() if k != "trend"})


@query(QUERIES, "ag14_token_totals")
def ag14(spark, sf):
    return SP.token_totals(SP.qualifying(_tally(spark, sf)))


ORACLE["ag14_token_totals"] = sql(f"""
SELECT t AS token, count(*) AS n FROM tok JOIN rows_in r ON r.video_id = tok.doc_id WHERE t IN ({_list(WORDS['hard'])}) GROUP BY t""",
    **{k: v for k, v in _SPEECH.items() if k != "trend"})


@query(QUERIES, "dp31_extremes")
def dp31_extremes(spark, sf):
    return SP.extremes(cut_lineage(SP.qualifying(_tally(spark, sf)).drop("hard_tokens")))


ORACLE["dp31_extremes"] = sql("""
SELECT * FROM (SELECT 'most' AS list, video_id, hard_per_100, hard FROM recent ORDER BY hard_per_100 DESC, video_id LIMIT 8) a
UNION ALL SELECT * FROM (SELECT 'least', video_id, hard_per_100, hard FROM recent ORDER BY hard_per_100, video_id LIMIT 5) b""",
    **{k: v for k, v in _SPEECH.items() if k != "trend"}, recent="SELECT * FROM rows_in ORDER BY published_at DESC, video_id DESC LIMIT 60")


@query(QUERIES, "dp32_transcriber_diagnostic")
def dp32(spark, sf):
    return SP.transcriber_diagnostic(SP.qualifying(_tally(spark, sf), min_seconds=0))


ORACLE["dp32_transcriber_diagnostic"] = sql("""
SELECT month, len(v) AS n, round(z / len(v) * 100, 3) AS zero_pct, v[CAST(floor(0.1::DOUBLE * (len(v) - 1)) AS INTEGER) + 1] AS p10,
       v[CAST(floor(len(v) / 2) AS INTEGER) + 1] AS median, v[CAST(floor(0.9::DOUBLE * (len(v) - 1)) AS INTEGER) + 1] AS p90
FROM (SELECT strftime(published_at, '%Y-%m') AS month, list_sort(list(hard_per_100)) AS v, count(*) FILTER (WHERE hard = 0) AS z
      FROM tally WHERE strftime(published_at, '%Y-%m') >= '2020-08' GROUP BY 1) g""", **{k: _SPEECH[k] for k in ("tok", "cnt", "tally")})


@query(QUERIES, "dp33_level_shift")
def dp33(spark, sf):
    return SP.level_shift(SP.monthly_trend(SP.qualifying(_tally(spark, sf))), base_from="2020-09", split="2021-09")


ORACLE["dp33_level_shift"] = sql("""
SELECT rate, round(b, 4) AS before, round(a, 4) AS after, round((a / nullif(b, 0) - 1) * 100, 2) AS change_pct FROM (
  SELECT rate, avg(CASE WHEN month >= '2020-09' AND month < '2021-09' THEN v END) AS b, avg(CASE WHEN month >= '2021-09' THEN v END) AS a
  FROM (SELECT month, unnest(['hard_per_100', 'rep_per_100']) AS rate, unnest([hard_per_100, rep_per_100]) AS v FROM trend) u GROUP BY rate) g""", **_SPEECH)

# ---- prices ----
_PRICES = {
    "kept": """
SELECT sku, day, m.c / 100.0::DOUBLE AS price, m AS r
FROM (SELECT sku, day, max(struct_pack(q := seq, p := price, a := available, s := status, l := label, c := cents)) AS m FROM price_scans GROUP BY sku, day) k""",
    "days": "SELECT day, row_number() OVER (ORDER BY day) - 1 AS day_ix FROM (SELECT DISTINCT day FROM price_obs) d",
    "rd": """
SELECT sku, day, day_ix, CASE WHEN regexp_full_match(r.a, '\\d+') THEN TRY_CAST(r.a AS BIGINT) END AS stock, price, r.s AS status, r.l AS label
FROM kept JOIN days USING (day)""",
    "pc": "SELECT sku, price, count(*) AS n, count(*) FILTER (WHERE status LIKE 'ok%' AND stock > 0) AS n_in FROM rd GROUP BY sku, price",
    "modal": """
SELECT sku, coalesce(min(CASE WHEN n_in > 0 THEN struct_pack(a := -n_in, p := price) END).p, min(struct_pack(a := -n, p := price)).p) AS modal FROM pc GROUP BY sku""",
    "bad": "SELECT day, count(*) FILTER (WHERE price > 1.35::DOUBLE * modal) AS high_skus FROM rd JOIN modal USING (sku) GROUP BY day HAVING count(*) FILTER (WHERE price > 1.35::DOUBLE * modal) >= 5",
    "nb": """
SELECT *, coalesce(day_ix - lag(day_ix, 1) OVER w = 1 AND abs(lag(price, 1) OVER w - price) <= 0.08::DOUBLE * price, FALSE) AS l1,
          coalesce(day_ix - lag(day_ix, 2) OVER w = 2 AND abs(lag(price, 2) OVER w - price) <= 0.08::DOUBLE * price, FALSE) AS l2,
          coalesce(lead(day_ix, 1) OVER w - day_ix = 1 AND abs(lead(price, 1) OVER w - price) <= 0.08::DOUBLE * price, FALSE) AS r1,
          coalesce(lead(day_ix, 2) OVER w - day_ix = 2 AND abs(lead(price, 2) OVER w - price) <= 0.08::DOUBLE * price, FALSE) AS r2
FROM rd WINDOW w AS (PARTITION BY sku ORDER BY day_ix)""",
    "held": "SELECT *, 1 + l1::INT + (l1 AND l2)::INT + r1::INT + (r1 AND r2)::INT >= 3 AS held FROM nb",
    "cleaned": """
SELECT h.sku, h.day, h.day_ix, h.stock, h.price AS raw_price, (price > 1.35::DOUBLE * modal OR (price < 0.65::DOUBLE * modal AND b.day IS NOT NULL)) AND NOT held AS nulled
FROM held h JOIN modal USING (sku) LEFT JOIN bad b ON b.day = h.day""",
}


def _p(upto: str) -> dict:
    out = {}
    for k, v in _PRICES.items():
        out[k] = v
        if k == upto:
            break
    return out


def _readings(spark, sf):
    # SKU-days are far fewer than scans, and every price product reads them several times.
    return cut_lineage(P.parsed(T.price_observations(spark, sf)))


@query(QUERIES, "dp34_aligned_grid")
def dp34(spark, sf):
    r = _readings(spark, sf)
    return P.dense_grid(P.price_runs(r), r.select("day_ix", "day").distinct()).select("sku", F.date_format("day", "yyyy-MM-dd").alias("day"), "stock", "price")


ORACLE["dp34_aligned_grid"] = sql("""
SELECT s.sku, strftime(d.day, '%Y-%m-%d') AS day, r.stock, r.price FROM (SELECT DISTINCT sku FROM rd) s CROSS JOIN days d
LEFT JOIN rd r ON r.sku = s.sku AND r.day = d.day""", "price_scans", **_p("rd"))


@query(QUERIES, "dp34_price_runs")
def dp34_runs(spark, sf):
    return P.price_runs(_readings(spark, sf))


ORACLE["dp34_price_runs"] = sql("""
SELECT sku, min(day_ix) AS first_ix, max(day_ix) AS last_ix, was_read, stock, price
FROM (SELECT s.sku, d.day_ix, r.sku IS NOT NULL AS was_read, r.stock, r.price,
             d.day_ix - row_number() OVER (PARTITION BY s.sku, r.sku IS NOT NULL, r.stock, r.price ORDER BY d.day_ix) AS island
      FROM (SELECT DISTINCT sku FROM rd) s CROSS JOIN days d LEFT JOIN rd r ON r.sku = s.sku AND r.day = d.day) g
GROUP BY sku, was_read, stock, price, island""", "price_scans", **_p("rd"))


def _catalogue(spark, sf):
    """The hand-kept catalogue: a supplier is a SKU, and some entries leave label or size blank."""
    k = F.col("s_suppkey")
    return T.table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), k.cast("string")).alias("sku"),
        F.when(k % 4 == 0, F.concat(F.lit(" Whole Bean - "), "s_name")).when(k % 4 == 2, F.col("s_name")).when(k % 4 == 3, " ").alias("label"),
        F.when(k % 5 == 0, " 16oz").when(k % 5 == 1, " ").alias("size"))


@query(QUERIES, "dp34_sku_catalogue")
def dp34_skus(spark, sf):
    r = _readings(spark, sf)
    return P.sku_catalogue(r, P.modal_price(r), _catalogue(spark, sf)).withColumn("last_reading", F.date_format("last_reading", "yyyy-MM-dd"))


ORACLE["dp34_sku_catalogue"] = sql("""
SELECT sku, CASE WHEN strpos(label, ' - ') > 0 THEN trim(substr(label, strpos(label, ' - ') + 3)) ELSE label END AS name, fam AS family,
       coalesce(nullif(trim(size), ''), CASE WHEN fam = 'K-Cups' THEN '12-pack' WHEN lower(label) LIKE '%kona%' THEN '7oz' WHEN modal >= 45 THEN '5lb' ELSE '12oz' END) AS size,
       modal, last_reading
FROM (SELECT *, CASE WHEN split_part(label, ' - ', 1) IN ('K-Cups', 'Ground', 'Whole Bean') AND strpos(label, ' - ') > 0 THEN split_part(label, ' - ', 1) ELSE 'Other' END AS fam
      FROM (SELECT r.sku, r.last_reading, c.size, coalesce(nullif(trim(c.label), ''), r.read_label) AS label
            FROM (SELECT sku, max_by(label, day) AS read_label, strftime(max(CASE WHEN stock IS NOT NULL THEN day END), '%Y-%m-%d') AS last_reading FROM rd GROUP BY sku) r
            LEFT JOIN (SELECT 'S' || s_suppkey AS sku, CASE s_suppkey % 4 WHEN 0 THEN ' Whole Bean - ' || s_name WHEN 2 THEN s_name WHEN 3 THEN ' ' END AS label,
                              CASE s_suppkey % 5 WHEN 0 THEN ' 16oz' WHEN 1 THEN ' ' END AS size FROM supplier) c USING (sku)) l) x
JOIN modal USING (sku)""", "price_scans", **_p("modal"))


@query(QUERIES, "ag7_modal_price")
def ag7(spark, sf):
    return P.modal_price(_readings(spark, sf))


ORACLE["ag7_modal_price"] = sql("SELECT * FROM modal", "price_scans", **_p("modal"))


@query(QUERIES, "dp35_bad_days")
def dp35(spark, sf):
    r = _readings(spark, sf)
    return P.bad_days(r, P.modal_price(r)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


ORACLE["dp35_bad_days"] = sql("SELECT strftime(day, '%Y-%m-%d') AS day, high_skus FROM bad", "price_scans", **_p("bad"))


@query(QUERIES, "wn8_held_prices")
def wn8(spark, sf):
    return P.with_held(_readings(spark, sf)).select("sku", "day_ix", "price", "held")


ORACLE["wn8_held_prices"] = sql("SELECT sku, day_ix, price, held FROM held", "price_scans", **_p("held"))


def _cleaned(spark, sf):
    r = _readings(spark, sf)
    modal = P.modal_price(r)
    return P.clean_prices(r, modal, P.bad_days(r, modal))


@query(QUERIES, "dp36_clean_prices")
def dp36(spark, sf):
    return _cleaned(spark, sf).select("sku", "day_ix", "raw_price", "price", "nulled")


ORACLE["dp36_clean_prices"] = sql("""
SELECT sku, day_ix, raw_price, CASE WHEN NOT nulled THEN raw_price END AS price, nulled FROM cleaned""", "price_scans", **_PRICES)


@query(QUERIES, "dp36_nulled_counts")
def dp36_counts(spark, sf):
    return P.nulled_counts(_cleaned(spark, sf))


ORACLE["dp36_nulled_counts"] = sql("""
SELECT sku, count(*) FILTER (WHERE nulled) AS nulled, count(*) FILTER (WHERE NOT nulled) AS kept FROM cleaned GROUP BY sku""", "price_scans", **_PRICES)


@query(QUERIES, "dp38_sales")
def dp38(spark, sf):
    r = _readings(spark, sf)
    return P.sales(r, P.modal_price(r))


ORACLE["dp38_sales"] = sql("""
SELECT sku, sold, restocked, CAST(floor(sold * modal * 100 + 0.5) AS BIGINT) AS revenue_cents,
       CAST(floor(sold * modal * 0.3::DOUBLE * 100 + 0.5) AS BIGINT) AS margin_cents
FROM (SELECT sku, CAST(coalesce(sum(CASE WHEN d < 0 THEN -d END), 0) AS BIGINT) AS sold, CAST(coalesce(sum(CASE WHEN d > 0 THEN d END), 0) AS BIGINT) AS restocked
      FROM (SELECT sku, stock - lag(stock) OVER (PARTITION BY sku ORDER BY day_ix) AS d FROM rd WHERE stock IS NOT NULL) x GROUP BY sku) s JOIN modal USING (sku)""",
    "price_scans", **_p("modal"))

_VARIANTS = ["Ground / 12oz", "Whole Bean / 5lb", "12 Pack", "Ground / 7oz", "Gift card"]


def _second(spark, sf):
    key = F.col("l_suppkey")
    price = F.format_string("$%d.99", (10 + key % 15).cast("bigint"))
    return T.table(spark, sf, "lineitem").select(
        F.concat(F.lit("Blend "), (key % 30).cast("string"), F.when(key % 7 == 0, " Kcup").otherwise("")).alias("product"),
        F.element_at(F.array(*[F.lit(v) for v in _VARIANTS]), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("variant"),
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("day"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("seq"),
        F.when(F.col("l_quantity") == 1, "").otherwise(price).alias("price"),
        F.format_string("$%d.50", (8 + F.col("l_partkey") % 20).cast("bigint")).alias("compare_at"),
        F.when(F.col("l_quantity") % 9 == 0, "many").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("stock"),
        F.when(F.col("l_returnflag") == "R", "sold_out").when(F.col("l_linestatus") == "O", "in_stock").otherwise("error").alias("status"))


_SECOND = {
    "obs2": f"""
SELECT 'Blend ' || CAST(l_suppkey % 30 AS VARCHAR) || CASE WHEN l_suppkey % 7 = 0 THEN ' Kcup' ELSE '' END AS product,
       [{_list(_VARIANTS)}][l_linenumber % 5 + 1] AS variant, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, l_orderkey * 100000 + l_partkey AS seq,
       struct_pack(p := CASE WHEN l_quantity <> 1 THEN (10 + l_suppkey % 15 + 0.99)::DOUBLE END, c := (8 + l_partkey % 20 + 0.5)::DOUBLE,
         s := CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'O' AND l_quantity % 9 <> 0 THEN CAST(l_quantity AS BIGINT) END) AS r,
       struct_pack(q := l_orderkey * 100000 + l_partkey, p := CASE WHEN l_quantity <> 1 THEN '$' || CAST(10 + l_suppkey % 15 AS VARCHAR) || '.99' ELSE '' END,
         c := '$' || CAST(8 + l_partkey % 20 AS VARCHAR) || '.50', s := CASE WHEN l_quantity % 9 = 0 THEN 'many' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END,
         t := CASE WHEN l_returnflag = 'R' THEN 'sold_out' WHEN l_linestatus = 'O' THEN 'in_stock' ELSE 'error' END) AS latest FROM lineitem""",
    "kept2": "SELECT product, variant, day, arg_max(r, latest) AS r FROM obs2 GROUP BY product, variant, day",
    "rd2": "SELECT product, variant, day, r.s AS stock, r.p AS price, CASE WHEN r.c > r.p THEN r.c END AS compare_at FROM kept2",
}


@query(QUERIES, "dp37_second_store")
def dp37(spark, sf):
    return P.second_store(_second(spark, sf)).withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "stock": F.col("stock").cast("bigint")})


ORACLE["dp37_second_store"] = sql("SELECT product, variant, strftime(day, '%Y-%m-%d') AS day, stock, price, compare_at FROM rd2", **_SECOND)


@query(QUERIES, "dp37_second_catalogue")
def dp37_skus(spark, sf):
    return P.second_store_catalogue(P.second_store(_second(spark, sf))).withColumn("last_reading", F.date_format("last_reading", "yyyy-MM-dd"))


ORACLE["dp37_second_catalogue"] = sql("""
SELECT product, variant, CASE WHEN variant = '12 Pack' OR product LIKE '%Kcup' THEN 'K-Cups' WHEN variant LIKE 'Whole Bean%' THEN 'Whole Bean' WHEN variant LIKE 'Ground%' THEN 'Ground' ELSE 'Other' END AS family,
       CASE WHEN variant LIKE '%5lb' THEN '5lb' WHEN variant LIKE '%7oz' THEN '7oz' WHEN variant LIKE '%12oz' THEN '12oz' WHEN variant = '12 Pack' OR product LIKE '%Kcup' THEN '12-pack' ELSE '' END AS size,
       max_by(price, CASE WHEN price IS NOT NULL THEN day END) AS price, strftime(max(CASE WHEN stock IS NOT NULL THEN day END), '%Y-%m-%d') AS last_reading
FROM rd2 GROUP BY product, variant""", **_SECOND)
