"""Text and metadata: B11, E17, E18, H1, H3, H5-H12, H14-H19, H25-H27, H30, H34, I6, J6."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, media
from ..functions import textmine as tm
from ..operators import places as pl
from ..registry import query
from ..sources import bindings as b

def _steps(t: str, patterns: list[str]) -> str:
    for p in patterns:
        t = f"regexp_replace({t}, '{p}', '')"
    return t


OPENED = _steps("trim(t)", tm.OPENING)
CLEAN = f"regexp_replace({_steps(f"CASE WHEN regexp_matches({OPENED}, '{tm.SHOWN}') THEN regexp_replace({OPENED}, '{tm.SHOWN}', '') ELSE trim(t) END", tm.SHORTER)}, '{tm.EDGES}', '', 'g')"
#: Every customer asks something, in one of several wordings about its own words.
LOG = """log AS (SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN concat('Show me pictures of ', lower(c_mktsegment), '?') WHEN 1 THEN concat('how many dogs and cats in ', 1995 + c_custkey % 20) WHEN 2 THEN concat('Find trains from ', n_name, ' ', 2000 + c_custkey % 9, ' to 2015')
    WHEN 3 THEN concat('describe those photos ', c_custkey % 400, ' and ', c_custkey % 30) WHEN 4 THEN 'remove the car from photo 2' WHEN 5 THEN concat('replace the dog with a cat in ', c_custkey % 90) WHEN 6 THEN concat('more cars or bikes since 20', 10 + c_custkey % 10, '?') ELSE concat('hello ', c_name) END AS t,
    c_custkey % 3 = 0 AS prev FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def log(spark, d):
    c, n = b.read(spark, d, "customer"), b.read(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).selectExpr("c_custkey as id", """case c_custkey % 8 when 0 then concat('Show me pictures of ', lower(c_mktsegment), '?') when 1 then concat('how many dogs and cats in ', 1995 + c_custkey % 20)
        when 2 then concat('Find trains from ', n_name, ' ', 2000 + c_custkey % 9, ' to 2015') when 3 then concat('describe those photos ', c_custkey % 400, ' and ', c_custkey % 30) when 4 then 'remove the car from photo 2'
        when 5 then concat('replace the dog with a cat in ', c_custkey % 90) when 6 then concat('more cars or bikes since 20', 10 + c_custkey % 10, '?') else concat('hello ', c_name) end as t""", "c_custkey % 3 = 0 as prev")


#: And every supplier in other wordings.
MORE = """CASE s_suppkey % 8 WHEN 0 THEN 'Make me a tall picture of a red bike' WHEN 1 THEN concat('save these as my ', lower(n_name), ' album') WHEN 2 THEN 'the teddy bear, a wine glass and the bears' WHEN 3 THEN concat('the first and the last, #', s_suppkey % 50)
    WHEN 4 THEN 'shot in sept 2020 at the beach' WHEN 5 THEN 'please make a vertical video of those' WHEN 6 THEN 'not a cat, why?' ELSE concat('get rid of the dog in photo ', s_suppkey % 9) END"""
MORE_LOG = f"more AS (SELECT 1000000 + s_suppkey AS id, {MORE} AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def more_log(spark, d):
    s, n = b.read(spark, d, "supplier"), b.read(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select((F.col("s_suppkey") + 1000000).alias("id"), F.expr(MORE).alias("t"))


@query("h1_clean_query", f"WITH {LOG} SELECT id, coalesce(nullif({CLEAN}, ''), trim(t)) AS cleaned FROM log")
def h1(spark, d):
    return log(spark, d).select("id", tm.clean_query(F.col("t")).alias("cleaned"))


@query("h3_place_parts", f"WITH {b.PLACES} SELECT asset_id, string_split(place, ', ') AS parts FROM places")
def h3(spark, d):
    return b.places(spark, d).select("asset_id", pl.parts(F.col("place")).alias("parts"))


@query("h6_is_plural", f"WITH {LOG} SELECT id, list_has_any(regexp_extract_all(lower(t), '([a-z]+)', 1), [{', '.join(repr(w) for w in tm.PLURALS)}]) AS plural FROM log")
def h6(spark, d):
    return log(spark, d).select("id", tm.is_plural(F.col("t")).alias("plural"))


@query("h7_extract_time")
def h7(spark, d):
    return tm.extract_time(log(spark, d).select("id", "t").unionByName(more_log(spark, d)), "t", dt.date(2031, 5, 14)).select("id", "time.*")


@query("h7_rest_of_month", f"WITH {MORE_LOG} SELECT id, CASE WHEN t LIKE 'shot in sept%' THEN '2020-09-01' END AS start, CASE WHEN t LIKE 'shot in sept%' THEN 'at the beach' END AS rest, CASE WHEN t LIKE 'shot in sept%' THEN 'from September 2020' END AS label FROM more")
def h7c(spark, d):
    return tm.extract_time(more_log(spark, d), "t", dt.date(2031, 5, 14)).select("id", "time.start", "time.rest", "time.label")


@query("h7_year_span", f"""WITH {LOG}, y AS (SELECT id, regexp_extract(t, '\\b((?:19|20)\\d\\d)\\b\\s*(?:-|to|and|until|till)\\s*\\b((?:19|20)\\d\\d)\\b', 1) AS a, regexp_extract(t, '\\b((?:19|20)\\d\\d)\\b\\s*(?:-|to|and|until|till)\\s*\\b((?:19|20)\\d\\d)\\b', 2) AS z, regexp_extract(t, '\\b((?:19|20)\\d\\d)\\b', 1) AS o FROM log)
    SELECT id, CAST(CASE WHEN a <> '' THEN least(a, z) ELSE nullif(o, '') END AS INTEGER) AS first, CAST(CASE WHEN a <> '' THEN greatest(a, z) ELSE nullif(o, '') END AS INTEGER) AS last FROM y""")
def h7b(spark, d):
    return log(spark, d).select("id", tm.year_span(F.col("t")).alias("y")).select("id", "y.first", "y.last")


@query("h8_extract_place", rf"""WITH {LOG}, {b.PLACES}, w AS (SELECT id, regexp_extract_all(t, '([\p{{L}}][\w''’-]*)', 1) AS w FROM log), b AS (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    s AS (SELECT * FROM b WHERE coalesce(lower(w[i - 1]) IN ('in', 'from', 'at', 'near', 'around'), false) OR regexp_matches(w[i], '^\p{{Lu}}')), p AS (SELECT id, i, w, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS n FROM s),
    a AS (SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM p UNION ALL SELECT id, 0, len(w), array_to_string(w, ' ') FROM w), names AS (SELECT strip_accents(lower(name)) AS key, min(name) AS name FROM (SELECT unnest(string_split(place, ', ')) AS name FROM places) GROUP BY 1),
    r AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY i, n DESC) AS rn FROM a JOIN names ON key = strip_accents(lower(phrase))) SELECT id, name FROM r WHERE rn = 1""")
def h8(spark, d):
    return tm.extract_place(log(spark, d), "t", b.places(spark, d), "id")


MESSAGE = "concat(' ', array_to_string(regexp_extract_all(regexp_replace(lower(t), '[''’]', '', 'g'), '([a-z0-9]+)', 1), ' '), ' ')"
INDEX = "MAP {" + ", ".join(f"'{w}': '{label}'" for w, label in tm.INDEX.items()) + "}"
#: Labels of the words w in order: two words go before one.
TAGS = f"list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND {INDEX}[concat(w[i - 1], ' ', w[i])] IS NOT NULL THEN NULL ELSE coalesce({INDEX}[concat(w[i], ' ', w[i + 1])], {INDEX}[w[i]]) END), lambda x: x IS NOT NULL)"
def listed(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


NOUNS = {"image": listed(n for x in tm.IMAGES for n in (x, x + "s")), "video": listed(n for x in tm.VIDEOS if " " not in x for n in (x, x + "s"))}
WS = "string_split(trim(m), ' ')"
P = f"coalesce(nullif(list_position(list_transform({WS}, lambda x: x IN {listed(tm.POLITE)}), false), 0), len({WS}) + 1)"
VERB = f"list_position(list_transform({WS}, lambda x: x IN {listed(tm.VIDEO_VERBS)}), true)"
MADE_IMAGE = f"""coalesce({WS}[{P}] IN {listed(tm.MAKE_VERBS)} AND len(list_filter(range(1, len({WS}) + 1), lambda i: i >= {P} AND {WS}[i] IN {NOUNS['image']} AND ({WS}[i + 1] IN ('of', 'showing', 'with') OR ({WS}[i + 1] = 'that' AND {WS}[i + 2] = 'shows')))) > 0, false)"""
MADE_VIDEO = f"""coalesce(len(list_filter(range(1, len({WS}) + 1), lambda i: i > {VERB} AND {VERB} > 0 AND ({WS}[i] IN {NOUNS['video']} OR ({WS}[i] = 'slide' AND {WS}[i + 1] IN ('show', 'shows'))))) > 0, false)"""
ALSO = {"create": f" AND ({MADE_IMAGE} OR {MADE_VIDEO})", "explain": f" AND NOT regexp_matches(m, '{tm.COUNTS}')", "compare": f" AND len(list_distinct({TAGS})) >= 2", "describe": f" AND regexp_matches(m, '{tm.ONE_PHOTO}')"}
RULES = " ".join(f"WHEN regexp_matches(m, '{rule}'){' AND prev' if previous else ''}{ALSO.get(name, '')} THEN '{name}'" for name, rule, previous in tm.INTENTS)
MESSAGES = f"SELECT *, {MESSAGE} AS m, regexp_extract_all(lower(t), '([a-z]+)', 1) AS w"


@query("h5_tag_labels", f"WITH {LOG}, {MORE_LOG} SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS labels FROM (SELECT id, {TAGS} AS l FROM (SELECT id, regexp_extract_all(lower(t), '([a-z]+)', 1) AS w FROM log UNION ALL SELECT id, regexp_extract_all(lower(t), '([a-z]+)', 1) AS w FROM more))")
def h5(spark, d):
    return log(spark, d).select("id", "t").unionByName(more_log(spark, d)).select("id", tm.tag_labels(F.col("t")).alias("labels"))


@query("h9_classify_intent", f"WITH {LOG} SELECT id, CASE {RULES} ELSE 'none' END AS intent FROM ({MESSAGES} FROM log)")
def h9(spark, d):
    return log(spark, d).select("id", tm.classify_intent(F.col("t"), F.col("prev")).alias("intent"))


@query("h9_conversation_intents", f"SELECT intent, count(*) AS n FROM (SELECT CASE {RULES} ELSE 'none' END AS intent FROM ({MESSAGES} FROM (SELECT text AS t, turn > 1 AS prev FROM conversations WHERE role = 'user'))) GROUP BY intent")
def h9b(spark, d):
    u = b.turns(spark, d).filter("role = 'user'")
    return u.groupBy(tm.classify_intent(F.col("text"), F.col("turn") > 1).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


@query("h10_photo_numbers", f"WITH {LOG} SELECT id, list_distinct(list_transform(regexp_extract_all(t, '\\b(\\d{{1,3}})\\b', 1), lambda x: CAST(x AS INTEGER))).list_sort() AS numbers FROM log")
def h10(spark, d):
    return log(spark, d).select("id", F.array_sort(tm.photo_numbers(F.col("t"))).alias("numbers"))


@query("h10_edit_request", f"WITH {LOG}, {MORE_LOG} SELECT id, coalesce(nullif(regexp_extract(t, '{tm.REPLACED}', 1), ''), nullif(regexp_extract(t, '{tm.REMOVED}', 1), '')) AS object, regexp_extract(t, '{tm.REPLACEMENT}', 1) AS replacement FROM (SELECT id, t FROM log UNION ALL SELECT id, t FROM more)")
def h10b(spark, d):
    return log(spark, d).select("id", "t").unionByName(more_log(spark, d)).select("id", tm.edit_request(F.col("t")).alias("r")).select("id", "r.*")


PLACES_SQL = f"list_distinct(list_concat(list_filter([{', '.join(f'CASE WHEN contains(m, ' + chr(39) + ' ' + w + ' ' + chr(39) + f') THEN {n} END' for w, n in tm.ORDINALS.items())}], lambda x: x IS NOT NULL), list_transform(regexp_extract_all(t, '\\b(\\d{{1,3}})\\b', 1), lambda x: CAST(x AS INTEGER))))"


@query("h10_photo_places", f"WITH {LOG}, {MORE_LOG} SELECT id, list_sort({PLACES_SQL}) AS places FROM ({MESSAGES} FROM (SELECT id, t FROM log UNION ALL SELECT id, t FROM more))")
def h10c(spark, d):
    return log(spark, d).select("id", "t").unionByName(more_log(spark, d)).select("id", F.array_sort(tm.photo_places(F.col("t"))).alias("places"))


@query("h10_create_request", f"""WITH {MORE_LOG} SELECT id, CASE WHEN {MADE_IMAGE} THEN 'image' WHEN {MADE_VIDEO} THEN 'video' END AS kind,
    CASE WHEN {MADE_IMAGE} THEN 'tall' WHEN {MADE_VIDEO} THEN 'vertical' END AS shape FROM ({MESSAGES} FROM more)""")
def h10d(spark, d):
    return more_log(spark, d).select("id", tm.create_request(F.col("t")).alias("r")).select("id", "r.kind", "r.shape")


@query("h10_selection_name", f"WITH {MORE_LOG} SELECT id, CASE WHEN t LIKE 'save%' THEN regexp_extract(t, 'as my (.*) album', 1) ELSE '' END AS name FROM more")
def h10e(spark, d):
    return more_log(spark, d).select("id", tm.selection_name(F.col("t")).alias("name"))


FILLERS = ", ".join(f"'{w}'" for w in tm.FILLER)


@query("h11_content_words", f"WITH {LOG} SELECT id, list_filter(regexp_extract_all(t, '([\\w''-]+)', 1), lambda w: lower(w) NOT IN ({FILLERS})) AS words FROM log")
def h11(spark, d):
    return log(spark, d).select("id", tm.content_words(F.col("t")).alias("words"))


@query("h12_fmt_ts", "WITH t AS (SELECT l_orderkey AS id, l_linenumber AS n, CAST(round(l_quantity * 37.25 * 10) AS BIGINT) AS x FROM lineitem) SELECT id, n, printf('%02dm%02d_%ds', x // 600, (x // 10) % 60, x % 10) AS label FROM t")
def h12(spark, d):
    return b.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), media.fmt_ts(F.col("l_quantity") * 37.25).alias("label"))


@query("h14_parse_exif_date", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE date_trunc('second', o_orderdate) END AS taken_at FROM orders")
def h14(spark, d):
    text = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    original = F.when(F.expr("o_orderkey % 4 = 1"), text).when(F.expr("o_orderkey % 4 = 2"), F.lit("0000:00:00 00:00:00")).otherwise(F.lit("broken"))
    digitised = F.when(F.expr("o_orderkey % 4 > 1"), text)
    return b.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), media.parse_exif_date(original, digitised).alias("taken_at"))


@query("h15_dms_to_degrees", "SELECT c_custkey AS id, CASE WHEN c_custkey % 120 + (c_custkey % 60) / 60.0 <= 90 THEN round((c_custkey % 120 + (c_custkey % 60) / 60.0) * CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END, 4) + 0.0 END AS lat FROM customer")
def h15(spark, d):
    v = geo.dms_to_degrees(F.expr("cast(c_custkey % 120 as double)"), F.expr("cast(c_custkey % 60 as double)"), F.lit(0.0), F.expr("if(c_custkey % 2 = 0, 'S', 'N')"), 90.0)
    return b.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.round(v, 4) + 0.0).alias("lat"))


@query("h16_parse_container_date", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN date_trunc('second', o_orderdate) ELSE date_trunc('second', o_orderdate) + INTERVAL 330 MINUTE END AS taken_at FROM orders")
def h16(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    local = F.when(F.expr("o_orderkey % 3 = 0"), F.lit("1904-01-01T00:00:00")).when(F.expr("o_orderkey % 3 = 1"), iso)
    return b.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), media.parse_container_date(local, F.when(F.expr("o_orderkey % 3 > 0"), iso), "Asia/Kolkata").alias("taken_at"))


@query("h17_parse_iso6709", f"WITH {b.POINTS} SELECT point_id, CASE WHEN point_id % 5 > 0 AND NOT (lat = 0 AND lon = 0) THEN lat END AS lat, CASE WHEN point_id % 5 > 0 AND NOT (lat = 0 AND lon = 0) THEN lon END AS lon FROM points")
def h17(spark, d):
    tag = F.when(F.expr("point_id % 5 > 0"), F.format_string("%+08.4f%+09.4f/", "lat", "lon")).otherwise(F.lit("somewhere"))
    return b.points(spark, d).select("point_id", geo.parse_iso6709(tag).alias("g")).select("point_id", "g.lat", "g.lon")


@query("h18_rate_and_size", "SELECT p_partkey AS id, round(CASE WHEN p_size % 4 = 0 THEN 0 ELSE 30000.0 / (p_size % 4) END, 3) AS fps, CASE WHEN p_size % 2 = 1 THEN 1080 ELSE 1920 END AS width FROM part")
def h18(spark, d):
    rate = F.concat(F.lit("30000/"), F.col("p_size") % 4)
    size = media.display_size(F.lit(1920), F.lit(1080), F.when(F.col("p_size") % 2 == 1, -90).otherwise(180))
    return b.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(media.parse_rate(rate), 3).alias("fps"), size["width"].alias("width"))


@query("h19_scaled_size", "SELECT p_partkey AS id, CAST(greatest(2, floor((p_size * 100) * least(1.0, 720.0 / greatest(p_size * 100, 1200)) / 2) * 2) AS INTEGER) AS width, CAST(greatest(2, floor(1200 * least(1.0, 720.0 / greatest(p_size * 100, 1200)) / 2) * 2) AS INTEGER) AS height FROM part")
def h19(spark, d):
    return b.read(spark, d, "part").select(F.col("p_partkey").alias("id"), media.scaled_size(F.col("p_size") * 100, F.lit(1200), 720).alias("s")).select("id", "s.*")


PLAN = """n AS (SELECT id, dur, CAST(floor((dur - 10) / 5 + 1e-9) AS INTEGER) AS n FROM d), w AS (SELECT id, dur, n, unnest(range(0, greatest(n, 0) + 1)) AS i FROM n),
    s AS (SELECT id, i * 5.0 AS a, CASE WHEN dur <= 10 THEN dur WHEN i = greatest(n, 0) AND dur - (i * 5.0 + 10) < 1 AND dur - (i * 5.0 + 10) > 1e-9 THEN dur ELSE i * 5.0 + 10 END AS z FROM w UNION ALL SELECT id, dur - 10, dur FROM n WHERE dur > 10 AND dur - (greatest(n, 0) * 5.0 + 10) >= 1)"""


@query("h25_plan_windows", f"WITH d AS (SELECT event_id AS id, floor(value) / 4 AS dur FROM events), {PLAN} SELECT id, round(a, 3) AS start_s, round(z, 3) AS end_s FROM s")
def h25(spark, d):
    e = b.read(spark, d, "events").select(F.col("event_id").alias("id"), (F.floor("value") / 4).alias("dur"))
    return e.select("id", F.explode(media.plan_windows(F.col("dur"), 10.0, 5.0)).alias("w")).select("id", "w.*")


@query("i6_media_windows", f"WITH d AS (SELECT event_type AS id, floor(value) / 4 AS dur FROM events), {PLAN} SELECT id, count(*) AS windows, round(sum(z - a), 1) AS seconds FROM s GROUP BY id")
def i6(spark, d):
    e = b.read(spark, d, "events").select(F.col("event_type").alias("id"), (F.floor("value") / 4).alias("dur"))
    w = e.select("id", F.explode(media.plan_windows(F.col("dur"), 10.0, 5.0)).alias("w"))
    return w.groupBy("id").agg(F.count(F.lit(1)).alias("windows"), F.round(F.sum(F.col("w.end_s") - F.col("w.start_s")), 1).alias("seconds"))


@query("h26_sample_times", "SELECT p_partkey AS id, list_filter(list_transform(range(0, greatest(1, CAST(ceil(p_size / 8.0 * 2) AS INTEGER))), lambda i: round((i + 0.5) / 2, 3)), lambda t: t < p_size / 8.0) AS times FROM part")
def h26(spark, d):
    return b.read(spark, d, "part").select(F.col("p_partkey").alias("id"), media.sample_times(F.lit(0.0), F.col("p_size") / 8.0, 2.0).alias("times"))


@query("h27_profile_key", """SELECT substr(sha256(concat('{"dim":"', event_type, '","precision":', user_id % 4, ',"window":10}')), 1, 16) AS profile_key, count(*) AS n FROM events GROUP BY 1""")
def h27(spark, d):
    p = F.struct(F.col("event_type").alias("dim"), F.expr("user_id % 4").alias("precision"), F.lit(10).alias("window"))
    return b.read(spark, d, "events").select(media.profile_key(p).alias("profile_key")).groupBy("profile_key").agg(F.count(F.lit(1)).alias("n"))


@query("h30_ordered_dedup", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN ['a', 'b'] ELSE ['a', 'b', 'c'] END AS parts FROM part")
def h30(spark, d):
    parts = F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.when(F.col("p_size") % 2 == 0, "b").otherwise("c"))
    return b.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_distinct(parts).alias("parts"))


@query("h34_ungrounded_numbers", "WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt, role FROM conversations) SELECT conv_id, turn, len(list_filter(list_distinct(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)', 1)), lambda x: NOT list_contains(regexp_extract_all(coalesce(prompt, ''), '(\\d+(?:\\.\\d+)?)', 1), x))) AS n FROM p WHERE role = 'assistant'")
def h34(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = b.turns(spark, d).withColumn("prompt", F.lag("text").over(w)).filter("role = 'assistant'")
    return t.select("conv_id", "turn", F.size(tm.ungrounded_numbers(F.col("text"), F.coalesce("prompt", F.lit("")))).cast("long").alias("n"))


@query("e17_conversation_context", "WITH t AS (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' AND length(text) % 2 = 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM conversations) SELECT * FROM t")
def e17(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.when((F.col("role") == "user") & (F.length("text") % 2 == 0), F.col("turn"))
    return b.turns(spark, d).select("conv_id", "turn", F.last(asked, ignorenulls=True).over(w).alias("seen"))


@query("e17_last_named_object", f"WITH n AS (SELECT conv_id, turn, role = 'user' AND len({TAGS}) > 0 AS named FROM (SELECT *, regexp_extract_all(lower(text), '([a-z]+)', 1) AS w FROM conversations)) SELECT conv_id, turn, last_value(CASE WHEN named THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS named_at FROM n")
def e17b(spark, d):
    return tm.conversation_context(b.turns(spark, d)).select("conv_id", "turn", F.col("before.turn").alias("named_at"))


@query("e18_retry_number", """WITH t AS (SELECT conv_id, turn, role, role = 'user' AND length(text) % 3 = 0 AS edit FROM conversations), g AS (SELECT *, sum(CAST(edit AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM t)
    SELECT conv_id, turn, CAST(1 + sum(CASE WHEN role = 'user' AND NOT edit THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, grp ORDER BY turn) AS BIGINT) AS retry FROM g WHERE grp > 0""")
def e18(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    edit = (F.col("role") == "user") & (F.length("text") % 3 == 0)
    g = b.turns(spark, d).withColumn("edit", edit).withColumn("grp", F.sum(F.col("edit").cast("int")).over(w)).filter("grp > 0")
    return g.select("conv_id", "turn", (1 + F.sum(F.when((F.col("role") == "user") & ~F.col("edit"), 1).otherwise(0)).over(Window.partitionBy("conv_id", "grp").orderBy("turn"))).alias("retry"))


@query("b11_admit", """WITH p AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE l_returnflag WHEN 'A' THEN 'image' WHEN 'N' THEN 'audio' ELSE 'video' END AS m, CAST(l_extendedprice * 100000 AS BIGINT) AS bytes, CASE WHEN l_quantity < 40 THEN CASE l_returnflag WHEN 'A' THEN 'png' ELSE 'mp4' END ELSE 'xyz' END AS f, l_quantity * 3000000 AS px, l_discount * 250000 AS dur FROM lineitem)
    SELECT id, n, CASE m WHEN 'image' THEN CASE WHEN bytes = 0 THEN 'empty' WHEN bytes > 209715200 THEN 'too large' WHEN f NOT IN ('jpeg', 'png', 'webp', 'heic', 'gif', 'bmp', 'tiff') THEN 'format' WHEN px > 80000000 THEN 'too many pixels' END
    WHEN 'audio' THEN CASE WHEN bytes > 1073741824 THEN 'too large' WHEN dur <= 0 THEN 'no sound' WHEN dur > 14400 THEN 'too long' END ELSE CASE WHEN f NOT IN ('mp4', 'mov', 'mkv', 'webm') THEN 'format' WHEN bytes > 8589934592 THEN 'too large' WHEN dur > 21600 THEN 'too long' END END AS reason FROM p""")
def b11(spark, d):
    probe = b.read(spark, d, "lineitem").selectExpr(
        "l_orderkey as id", "l_linenumber as n", "case l_returnflag when 'A' then 'image' when 'N' then 'audio' else 'video' end as media_type", "cast(round(l_extendedprice * 100000) as bigint) as bytes",
        "if(l_quantity < 40, if(l_returnflag = 'A', 'png', 'mp4'), 'xyz') as format", "l_quantity * 3000000 as pixels", "l_discount * 250000 as duration")
    return probe.select("id", "n", media.admit().alias("reason"))
