"""All queries of the library's own operators on the driver's tables, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.functions import scalars, statistics
from framescope.operators import citations, evaluation, integrity, relations, sequences, summaries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

STEPS = ("view", "click", "signup", "purchase")
EVENT_MEANINGS = {"view": "page shown", "click": "element used", "signup": "account made"}
CUTOFF = "2024-01-15 00:00:00"
KEY = b"framescope-sixteen-bytes"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def micros(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q03_sequence_mask(spark, sf_dir)


@query("q01_type_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q01_type_histogram(spark, sf_dir):
    return summaries.histogram(table(spark, sf_dir, "events"), ["event_type"])


@query(
    "q02_entity_summary",
    """SELECT user_id, count(*) AS n, max_by(event_type, event_id) AS last_any,
       coalesce(max_by(event_type, event_id) FILTER (WHERE event_type <> 'view'), max_by(event_type, event_id)) AS last_preferred,
       count(value) AS n_values, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean, min(event_id) AS first_order
       FROM events GROUP BY user_id""",
)
def q02_entity_summary(spark, sf_dir):
    found = summaries.entity_summary(table(spark, sf_dir, "events"), "user_id", F.col("event_id"), F.col("event_type"), F.col("event_type") != "view", F.col("value"))
    return found.withColumn("mean", F.round("mean", 6))


@query(
    "q03_sequence_mask",
    """SELECT *, mask = 15 AS complete FROM (
       SELECT user_id, CAST(ts AS DATE) AS day,
         CAST(bit_or(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 4 ELSE 8 END) AS INTEGER) AS mask,
         count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'click') AS n_click,
         count(*) FILTER (WHERE event_type = 'signup') AS n_signup, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase
       FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') GROUP BY user_id, CAST(ts AS DATE))""",
)
def q03_sequence_mask(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return summaries.step_mask(days, ["user_id", "day"], "event_type", STEPS)


@query("q04_reason_histogram", "SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS reason, count(*) AS n FROM events WHERE event_type IN ('error', 'click') AND value IS NOT NULL GROUP BY ALL")
def q04_reason_histogram(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("reason", F.floor(F.col("value") / 10))
    return summaries.histogram(events, ["event_type", "reason"], F.col("event_type").isin("error", "click") & F.col("value").isNotNull())


_LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("q05_filtered_list", f"SELECT {', '.join(_LINEITEM_ORDER)} FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05 AND l_quantity < 10 ORDER BY {', '.join(_LINEITEM_ORDER)} LIMIT 50")
def q05_filtered_list(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.05 and l_quantity < 10")
    return rows.select(*_LINEITEM_ORDER).orderBy(*_LINEITEM_ORDER).limit(50)


@query(
    "q06_code_lookup",
    """SELECT e.event_type, coalesce(m.meaning, 'unknown') AS meaning, count(*) AS n
       FROM events e LEFT JOIN (VALUES ('view', 'page shown'), ('click', 'element used'), ('signup', 'account made')) m(event_type, meaning) USING (event_type) GROUP BY ALL""",
)
def q06_code_lookup(spark, sf_dir):
    counted = summaries.histogram(table(spark, sf_dir, "events"), ["event_type"])
    return relations.code_lookup(counted, "event_type", EVENT_MEANINGS).select("event_type", "meaning", "n")


_LINES_SQL = r"(SELECT doc_id, unnest(w) AS content, generate_subscripts(w, 1) AS line, len(w) AS total_lines FROM (SELECT doc_id, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS w FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS s FROM documents WHERE text IS NOT NULL)))"


@query("q07_line_search", rf"SELECT doc_id, CAST(line AS INTEGER) AS line, sha256(content) AS content_sha256 FROM {_LINES_SQL} WHERE regexp_matches(content, '(?i)licen[sc]e|copyright')")
def q07_line_search(spark, sf_dir):
    found = sequences.search_lines(table(spark, sf_dir, "documents"), ["doc_id"], "text", "licen[sc]e|copyright")
    return found.select("doc_id", "line", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


@query("q08_line_range", f"SELECT doc_id, CAST(line AS INTEGER) AS line, content, CAST(total_lines AS INTEGER) AS total_lines FROM {_LINES_SQL} WHERE line BETWEEN 2 AND 5")
def q08_line_range(spark, sf_dir):
    return sequences.line_range(table(spark, sf_dir, "documents"), ["doc_id"], "text", 2, 5)


_SCRUB_SQL = """(SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'error' OR event_type <> 'view' THEN event_type = 'error' END IGNORE NULLS)
       OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), false) AS removed FROM events)"""


@query("q09_scrub_islands", f"SELECT user_id, count(*) FILTER (WHERE removed) AS n_removed, count(*) FILTER (WHERE NOT removed) AS n_kept, sum(event_id) FILTER (WHERE NOT removed)::BIGINT AS kept_ids FROM {_SCRUB_SQL} GROUP BY user_id")
def q09_scrub_islands(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    marked = sequences.scrub_echoes(events, ["user_id"], ["event_id"], F.col("event_type") == "error", F.col("event_type") == "view")
    return marked.groupBy("user_id").agg(F.count_if("removed").alias("n_removed"), F.count_if(~F.col("removed")).alias("n_kept"), F.sum(F.when(~F.col("removed"), F.col("event_id"))).alias("kept_ids"))


@query(
    "q10_head_tail_budget",
    """WITH s AS (SELECT conv_id, turn, length(text) + 1 AS size FROM conversations WHERE text IS NOT NULL),
       r AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS up,
             sum(size) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS down, sum(size) OVER (PARTITION BY conv_id) AS total FROM s),
       h AS (SELECT *, coalesce(max(CASE WHEN up <= 90 THEN up END) OVER (PARTITION BY conv_id), 0) AS head FROM r)
       SELECT conv_id, turn, CASE WHEN total <= 600 OR up <= 90 THEN 'head' WHEN down <= 600 - head THEN 'tail' ELSE 'none' END AS keep FROM h""",
)
def q10_head_tail_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", (F.length("text") + 1).alias("size"))
    return sequences.head_tail(turns, ["conv_id"], ["turn"], F.col("size"), 600).select("conv_id", "turn", "keep")


@query(
    "q11_bounded_rows",
    """SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (
         SELECT conv_id, turn, row_number() OVER w AS r, 100 + sum(length(text) + 2) OVER (w ROWS UNBOUNDED PRECEDING) AS used
         FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE used <= 900 AND r <= 4""",
)
def q11_bounded_rows(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    return sequences.bounded_prefix(turns, ["conv_id"], ["turn"], F.length("text") + 2, 900, 4, start=100).select("conv_id", "turn", "used")


@query("q12_cutoff", f"SELECT event_type, count(*) FILTER (WHERE ts <= TIMESTAMP '{CUTOFF}') AS kept, count(*) FILTER (WHERE ts > TIMESTAMP '{CUTOFF}') AS dropped FROM events GROUP BY event_type")
def q12_cutoff(spark, sf_dir):
    return relations.cutoff(table(spark, sf_dir, "events"), micros("ts"), F.unix_micros(F.to_timestamp(F.lit(CUTOFF + "+00:00"))), ["event_type"])


@query(
    "q13_direction",
    """SELECT CASE WHEN c.c_nationkey = s.s_nationkey THEN 'same' WHEN cn.n_regionkey = sn.n_regionkey THEN 'region' WHEN c.c_nationkey < s.s_nationkey THEN 'up' ELSE 'down' END AS direction, count(*) AS n
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
       JOIN nation cn ON cn.n_nationkey = c.c_nationkey JOIN nation sn ON sn.n_nationkey = s.s_nationkey GROUP BY ALL""",
)
def q13_direction(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", "n_regionkey")
    # nations are joined to the two dimensions first: the large table meets two narrow ones, by keys alone
    buyers = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", F.col("n_regionkey").alias("c_region"))
    sellers = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("n_regionkey").alias("s_region"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    rows = t("lineitem").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    side = F.coalesce(relations.first_reason([("same", F.col("c_nationkey") == F.col("s_nationkey")), ("region", F.col("c_region") == F.col("s_region")), ("up", F.col("c_nationkey") < F.col("s_nationkey"))]), F.lit("down"))
    return summaries.histogram(rows.select(side.alias("direction")), ["direction"])


_FIRST_SQL = "(SELECT user_id, event_type, (epoch_us(min(ts)) - epoch_us(min(min(ts)) OVER (PARTITION BY user_id))) / 1e6 AS elapsed FROM events GROUP BY user_id, event_type)"


@query("q14_first_events", f"SELECT user_id, event_type, round(elapsed, 6) AS elapsed FROM {_FIRST_SQL}")
def q14_first_events(spark, sf_dir):
    return summaries.first_events(table(spark, sf_dir, "events"), "user_id", "event_type", micros("ts")).withColumn("elapsed", F.round("elapsed", 6))


@query(
    "q15_event_summary",
    f"""SELECT event_type, count(elapsed) AS n, round(min(elapsed), 6) AS least, round(quantile_cont(elapsed, 0.5), 6) AS median, round(max(elapsed), 6) AS greatest,
        (SELECT count(DISTINCT user_id) FROM events) AS available FROM {_FIRST_SQL} GROUP BY event_type""",
)
def q15_event_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    firsts = summaries.first_events(events, "user_id", "event_type", micros("ts"))
    found = summaries.spread_summary(firsts, ["event_type"], "elapsed", events, "user_id")
    return found.withColumns({c: F.round(c, 6) for c in ("least", "median", "greatest")})


@query("q16_outcome_joint", "SELECT coalesce(quality::VARCHAR, 'unknown') AS quality, coalesce(toxic::VARCHAR, 'unknown') AS toxic, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def q16_outcome_joint(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return summaries.joint_distribution(joined, ["quality", "toxic"])


_CENTROID_SQL = """WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
  c AS (SELECT label AS prediction, d, avg(x) AS m FROM p GROUP BY label, d),
  n AS (SELECT vec_id, label, prediction, round(sum((x - m) * (x - m)), 9) AS dist FROM p JOIN c USING (d) GROUP BY ALL),
  g AS (SELECT vec_id, label, arg_min(prediction, (dist, prediction)) AS prediction FROM n GROUP BY vec_id, label) """


@query("q17_confusion", _CENTROID_SQL + "SELECT label, prediction, count(*) AS n FROM g GROUP BY ALL")
def q17_confusion(spark, sf_dir):
    return summaries.confusion(relations.nearest_centroid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"), "label", "prediction")


@query(
    "q17b_class_scores",
    _CENTROID_SQL
    + """, k AS (SELECT label AS class FROM g UNION SELECT prediction FROM g), s AS (SELECT class, (SELECT count(*) FROM g WHERE label = class) AS support,
  (SELECT count(*) FROM g WHERE prediction = class) AS predicted, (SELECT count(*) FROM g WHERE label = class AND prediction = class) AS hits FROM k)
  SELECT class, support, predicted, hits, round(CASE WHEN support > 0 THEN hits / support END, 9) AS recall, round(2 * hits / (support + predicted), 9) AS f1 FROM s""",
)
def q17b_class_scores(spark, sf_dir):
    graded = relations.nearest_centroid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return summaries.class_scores(graded, "label", "prediction").withColumns({"recall": F.round("recall", 9), "f1": F.round("f1", 9)})


def _graded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("source", "quality", (F.col("n_chars") >= 600).cast("int").alias("by_length"), (F.col("source") != "src0").cast("int").alias("by_source"))


_GRADED_SQL = "(SELECT source, quality, CAST(n_chars >= 600 AS INTEGER) AS a, CAST(source <> 'src0' AS INTEGER) AS b FROM documents JOIN labels USING (doc_id))"


@query(
    "q18_paired",
    f"""SELECT count(*) AS n, count(*) FILTER (WHERE a = quality AND b = quality) AS both, count(*) FILTER (WHERE a = quality AND b <> quality) AS only_left,
        count(*) FILTER (WHERE a <> quality AND b = quality) AS only_right, count(*) FILTER (WHERE a <> quality AND b <> quality) AS neither,
        round((count(*) FILTER (WHERE a = quality AND b <> quality) - count(*) FILTER (WHERE a <> quality AND b = quality)) / count(*), 9) AS difference FROM {_GRADED_SQL}""",
)
def q18_paired(spark, sf_dir):
    return relations.paired_grades(_graded(spark, sf_dir), "quality", "by_length", "by_source").withColumn("difference", F.round("difference", 9))


@query("q19_quantiles", "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def q19_quantiles(spark, sf_dir):
    found = summaries.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return found.withColumns({"p50": F.round("p50", 6), "p95": F.round("p95", 6)})


@query(
    "q20_cost",
    """WITH c AS (SELECT l_returnflag, l_quantity * 100 AS p, CASE WHEN l_linenumber < 7 THEN l_partkey % 1000 END AS o, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey * 30.0 ELSE 0.0 END AS h, CASE WHEN l_tax > 0.01 THEN 0.5 END AS hr FROM lineitem),
       s AS (SELECT *, CASE WHEN o IS NULL THEN 'missing_usage' WHEN h > p THEN 'invalid_cached_usage' WHEN h > 0 AND hr IS NULL THEN 'missing_price' ELSE 'estimated_from_returned_usage' END AS status FROM c)
       SELECT l_returnflag, status, count(*) AS n, round(sum(CASE WHEN status = 'estimated_from_returned_usage' THEN ((p - h) * 3.0 + o * 15.0 + h * coalesce(hr, 0.0)) / 1e6 END), 6) AS cost FROM s GROUP BY ALL""",
)
def q20_cost(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    cached = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey") * 30.0).otherwise(0.0)
    completion = F.when(F.col("l_linenumber") < 7, F.col("l_partkey") % 1000)
    cost = scalars.call_cost(F.col("l_quantity") * 100, completion, cached, F.lit(3.0), F.lit(15.0), F.when(F.col("l_tax") > 0.01, 0.5))
    return rows.select("l_returnflag", cost.alias("c")).groupBy("l_returnflag", F.col("c.status").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("c.cost"), 6).alias("cost"))


@query(
    "q21_contains",
    r"""SELECT b.item_id, count(*) AS n_documents, min(d.doc_id) AS first_document, sum(instr(d.text, b.text))::BIGINT AS places, count(*) > 1 AS ambiguous
        FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(regexp_replace(b.text, '\s', '', 'g')) >= 12 GROUP BY b.item_id""",
)
def q21_contains(spark, sf_dir):
    hits = relations.passage_hits(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return hits.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_document"), F.sum("first_at").alias("places"), (F.count("*") > 1).alias("ambiguous"))


_HMAC_SQL = "sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode(c_name))))".format(outer=bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0")).hex(), inner=bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0")).hex())


@query(
    "q22_pseudonym",
    f"""SELECT c_custkey, h AS digest, printf('%02x', (('0x' || h[1:2])::INTEGER | 2) & 254) || ':' || h[3:4] || ':' || h[5:6] || ':' || h[7:8] || ':' || h[9:10] || ':' || h[11:12] AS pseudonym
        FROM (SELECT c_custkey, {_HMAC_SQL} AS h FROM customer)""",
)
def q22_pseudonym(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select("c_custkey", scalars.hmac_sha256(KEY, F.col("c_name")).alias("digest"))
    return named.withColumn("pseudonym", scalars.hardware_pseudonym(F.col("digest")))


@query("q23_digest", "SELECT doc_id, sha256(text) AS digest, length(text) <> n_chars AS mismatch FROM documents WHERE text IS NOT NULL")
def q23_digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (F.length("text") != F.col("n_chars")).alias("mismatch"))


@query("q24_set_diff", "SELECT 'left' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def q24_set_diff(spark, sf_dir):
    return relations.set_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    "q25_schedule",
    """WITH s AS (SELECT ['view', 'click', 'signup', 'purchase', 'error'][(i // 12 + 1)::BIGINT] AS class, CASE WHEN i % 12 < 4 THEN 'dev' ELSE 'test' END AS split, 100 + i AS seed FROM range(60) r(i))
       SELECT s.class, s.split, s.seed, e.event_id IS NOT NULL AS matches FROM s LEFT JOIN events e ON e.event_id = s.seed AND e.event_type = s.class""",
)
def q25_schedule(spark, sf_dir):
    plan = relations.seed_schedule(spark, 100, [*STEPS, "error"])
    seen = table(spark, sf_dir, "events").select(F.col("event_id").alias("seed"), F.col("event_type").alias("class"), F.lit(True).alias("matches"))
    return plan.join(seen, ["seed", "class"], "left").select("class", "split", "seed", F.coalesce("matches", F.lit(False)).alias("matches"))


@query(
    "q26_monotone",
    """WITH m AS (SELECT user_id, row_number() OVER w AS r, value < lag(value) OVER w AS fall FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
       SELECT user_id, count(*) AS n, count(*) FILTER (WHERE fall) AS n_falls, CAST(min(r) FILTER (WHERE fall) AS INTEGER) AS first_fall FROM m GROUP BY user_id""",
)
def q26_monotone(spark, sf_dir):
    return sequences.falls(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value")


@query("q27_stratified_top3", "SELECT lang, source, doc_id, CAST(r AS INTEGER) AS rank FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r <= 3")
def q27_stratified_top3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars")
    return sequences.stratified_top(docs, ["lang", "source"], ["n_chars", "doc_id"], 3).select("lang", "source", "doc_id", "rank")


@query(
    "q28_exclusions",
    """WITH f AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)
       SELECT CASE WHEN d.n_chars < 200 THEN 'short' WHEN f.doc_id <> d.doc_id THEN 'duplicate' WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'none' END AS reason, count(*) AS n
       FROM documents d JOIN f ON d.text = f.text LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY ALL""",
)
def q28_exclusions(spark, sf_dir):
    # a digest stands for the text, so that no text is shuffled
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    rows = docs.join(first, "digest").join(labelled, "doc_id", "left")
    reason = relations.first_reason([("short", F.col("n_chars") < 200), ("duplicate", F.col("first_id") != F.col("doc_id")), ("unlabelled", F.col("labelled").isNull())])
    return summaries.histogram(rows.select(F.coalesce(reason, F.lit("none")).alias("reason")), ["reason"])


@query(
    "q29_clopper",
    """WITH RECURSIVE g AS (SELECT source, count(*) FILTER (WHERE quality = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source),
  b AS (SELECT source, k, n, 0 AS i, 0.0::DOUBLE AS la, 1.0::DOUBLE AS lb, 0.0::DOUBLE AS ha, 1.0::DOUBLE AS hb FROM g
    UNION ALL
    SELECT source, k, n, i + 1, CASE WHEN low_above THEN la ELSE lm END, CASE WHEN low_above THEN lm ELSE lb END, CASE WHEN high_above THEN ha ELSE hm END, CASE WHEN high_above THEN hm ELSE hb END
    FROM (SELECT *, coalesce(list_sum(list_transform(range(k, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(lm) + (n - j) * ln(1 - lm)))), 0) > 0.025 AS low_above,
      1 - coalesce(list_sum(list_transform(range(k + 1, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(hm) + (n - j) * ln(1 - hm)))), 0) < 0.025 AS high_above
      FROM (SELECT *, (la + lb) / 2 AS lm, (ha + hb) / 2 AS hm FROM b WHERE i < 50)))
  SELECT source, k, n, round(CASE WHEN k = 0 THEN 0 ELSE (la + lb) / 2 END, 9) AS low, round(CASE WHEN k = n THEN 1 ELSE (ha + hb) / 2 END, 9) AS high FROM b WHERE i = 50""",
)
def q29_clopper(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    rates = docs.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    return rates.withColumn("ci", statistics.clopper_pearson(F.col("k"), F.col("n"))).select("source", "k", "n", F.round("ci.low", 9).alias("low"), F.round("ci.high", 9).alias("high"))


@query(
    "q30_mcnemar",
    f"""WITH c AS (SELECT source, count(*) FILTER (WHERE a = quality AND b <> quality) AS b, count(*) FILTER (WHERE a <> quality AND b = quality) AS c FROM {_GRADED_SQL} GROUP BY source),
        t AS (SELECT source, b, c, i FROM c, LATERAL (SELECT unnest(range(greatest(b, c), b + c + 1)) AS i))
        SELECT source, b AS only_left, c AS only_right, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) END, 6) AS p_value FROM t GROUP BY source, b, c""",
)
def q30_mcnemar(spark, sf_dir):
    counted = relations.paired_grades(_graded(spark, sf_dir), "quality", "by_length", "by_source", ["source"])
    return counted.select("source", "only_left", "only_right", F.round(statistics.mcnemar_exact(F.col("only_left"), F.col("only_right")), 6).alias("p_value"))


@query(
    "q32_freq_channel",
    """SELECT channel, count(*) AS n, min(f) AS lowest, max(f) AS highest FROM (SELECT f, CAST(CASE WHEN f = 2484 THEN 14 WHEN f BETWEEN 2412 AND 2472 AND (f - 2407) % 5 = 0 THEN (f - 2407) // 5
       WHEN f BETWEEN 4910 AND 4980 AND f % 5 = 0 THEN (f - 4000) // 5 WHEN f BETWEEN 5000 AND 5895 AND f % 5 = 0 THEN (f - 5000) // 5 WHEN f = 5935 THEN 2
       WHEN f BETWEEN 5955 AND 7115 AND (f - 5950) % 5 = 0 THEN (f - 5950) // 5 WHEN f >= 58320 AND (f - 56160) % 2160 = 0 THEN (f - 56160) // 2160 ELSE 0 END AS INTEGER) AS channel FROM (SELECT CASE event_id % 4 WHEN 3 THEN 56160 + event_id % 9 * 2160 + event_id % 2 ELSE 2400 + event_id % 4801 END AS f FROM events)) GROUP BY channel""",
)
def q32_freq_channel(spark, sf_dir):
    """Every fourth event stands for a frequency about the 60 GHz channels, the others for the bands below."""
    e = F.col("event_id")
    heard = table(spark, sf_dir, "events").select(F.when(e % 4 == 3, 56160 + e % 9 * 2160 + e % 2).otherwise(2400 + e % 4801).alias("f"))
    found = heard.withColumn("channel", scalars.frequency_channel(F.col("f")))
    return found.groupBy("channel").agg(F.count("*").alias("n"), F.min("f").alias("lowest"), F.max("f").alias("highest"))


@query("q33_zscore", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(coalesce(nullif(stddev_pop(p_retailprice), 0), 1), 6) AS deviation FROM part GROUP BY p_brand")
def q33_zscore(spark, sf_dir):
    return summaries.standardised_means(table(spark, sf_dir, "part"), "p_brand", "p_retailprice").withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("q34_majority", "SELECT p_brand, arg_min(p_type, (-n, p_type)) AS p_type, max(n) AS n FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def q34_majority(spark, sf_dir):
    return summaries.majority(table(spark, sf_dir, "part"), ["p_brand"], "p_type")


@query("q35_rollup_total", "SELECT lang, count(*) AS n, grouping(lang) = 1 AS is_total FROM documents GROUP BY ROLLUP (lang)")
def q35_rollup_total(spark, sf_dir):
    return summaries.counts_with_total(table(spark, sf_dir, "documents"), "lang")


@query("q36_nullable_totals", "SELECT o_orderstatus, count(*) AS n, count(v) AS known, round(sum(v), 4) AS known_sum, round(CASE WHEN count(v) = count(*) THEN sum(v) END, 4) AS total FROM (SELECT o_orderstatus, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) GROUP BY o_orderstatus")
def q36_nullable_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(~((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 10 == 0)), F.col("o_totalprice")).alias("v"))
    return summaries.nullable_totals(rows, ["o_orderstatus"], "v").withColumns({"known_sum": F.round("known_sum", 4), "total": F.round("total", 4)})


@query(
    "q37_token_estimate",
    "SELECT conv_id, CAST(sum(strlen(text)) + 32 * count(*) + 256 AS BIGINT) AS tokens, sum(strlen(text)) + 32 * count(*) + 256 + 2048 <= 4096 AS fits FROM conversations WHERE text IS NOT NULL GROUP BY conv_id",
)
def q37_token_estimate(spark, sf_dir):
    joined = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("m"))
    tokens = F.col("b") + 32 * F.col("m") + 256
    return joined.select("conv_id", tokens.cast("long").alias("tokens"), (tokens + 2048 <= 4096).alias("fits"))


@query(
    "q38_quarantine",
    """WITH q AS (SELECT list_filter([CASE WHEN NOT coalesce(n_chars >= 200, false) THEN 'short' END, CASE WHEN NOT coalesce(lang IN ('en', 'fr'), false) THEN 'language' END,
       CASE WHEN NOT coalesce(source <> 'src0', false) THEN 'source' END], lambda x: x IS NOT NULL) AS r FROM documents)
       SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(r) = 0 THEN [NULL] ELSE r END) AS reason FROM q) GROUP BY reason""",
)
def q38_quarantine(spark, sf_dir):
    rules = {"short": F.col("n_chars") >= 200, "language": F.col("lang").isin("en", "fr"), "source": F.col("source") != "src0"}
    return integrity.quarantine_totals(integrity.with_quarantine(table(spark, sf_dir, "documents").select("n_chars", "lang", "source"), rules))


@query(
    "q39_manifest",
    """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'x' ELSE sha256(text) END AS d FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL),
       f AS (SELECT doc_id, sha256(text) AS d FROM documents WHERE doc_id % 11 <> 0 AND text IS NOT NULL)
       SELECT doc_id, CASE WHEN f.d IS NULL THEN 'missing' WHEN l.d IS NULL THEN 'unexpected' ELSE 'changed' END AS status FROM l FULL JOIN f USING (doc_id) WHERE l.d IS DISTINCT FROM f.d""",
)
def q39_manifest(spark, sf_dir):
    digests = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    listed = digests.where("doc_id % 7 <> 0").withColumn("digest", F.when(F.col("doc_id") % 10 == 3, "x").otherwise(F.col("digest")))
    return integrity.compare_manifest(listed, digests.where("doc_id % 11 <> 0"), ["doc_id"], "digest")


@query(
    "q40_leak_probe",
    """WITH r AS (SELECT vec_id AS id, label AS l, embedding AS v, vec_id % 5 <> 0 AS dev FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
  f AS (SELECT id, l, row_number() OVER (ORDER BY md5('9173:row:' || id), id) AS a, row_number() OVER (ORDER BY md5('9173:label:' || id), id) AS b FROM r WHERE dev),
  s AS (SELECT x.id, y.l AS s FROM f x JOIN f y ON x.a = y.b),
  p AS (SELECT id, l, dev, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) AS d FROM r),
  z AS (SELECT d, avg(x) AS mean, coalesce(nullif(stddev_pop(x), 0), 1) AS deviation FROM p WHERE dev GROUP BY d),
  n AS (SELECT id, l, dev, d, (x - mean) / deviation AS x FROM p JOIN z USING (d)),
  c AS (SELECT 'own' AS kind, l AS p, d, avg(x) AS m FROM n WHERE dev GROUP BY l, d UNION ALL SELECT 'shuffled', s, d, avg(x) FROM n JOIN s USING (id) WHERE dev GROUP BY s, d),
  t AS (SELECT id, l, kind, p, round(sum((x - m) * (x - m)), 9) AS dist FROM n JOIN c USING (d) WHERE NOT dev GROUP BY ALL),
  g AS (SELECT id, l, kind, arg_min(p, (dist, p)) AS p FROM t GROUP BY id, l, kind),
  o AS (SELECT arg_min(l, (-n, l)) AS top FROM (SELECT l, count(*) AS n FROM f GROUP BY l))
  SELECT n, hits, shuffled_hits, base_hits, (hits - base_hits) * 5 > n AS flagged FROM (SELECT count(*) FILTER (WHERE kind = 'own') AS n, count(*) FILTER (WHERE kind = 'own' AND l = p) AS hits,
    count(*) FILTER (WHERE kind = 'shuffled' AND l = p) AS shuffled_hits, count(*) FILTER (WHERE kind = 'own' AND l = top) AS base_hits FROM g, o)""",
)
def q40_leak_probe(spark, sf_dir):
    """Dev: vec_id not divisible by 5; test: the others."""
    return evaluation.leak_probe(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", F.col("vec_id") % 5 != 0)


@query("q41_bootstrap")
def q41_bootstrap(spark, sf_dir):
    found = evaluation.bootstrap_interval(table(spark, sf_dir, "labels"), [], "quality", "doc_id")
    return found.select("n", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


@query(
    "q42_citations",
    r"""WITH r AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE text IS NOT NULL),
       e AS (SELECT conv_id, CASE WHEN turn % 3 = 0 THEN turn + 1 ELSE turn END AS ref, t AS quote FROM r),
       q AS (SELECT DISTINCT conv_id, quote FROM e WHERE quote <> ''),
       h AS (SELECT q.conv_id, q.quote, r.turn FROM q JOIN r ON r.conv_id = q.conv_id AND contains(r.t, q.quote)),
       p AS (SELECT conv_id, quote, count(*) AS places FROM h GROUP BY ALL),
       a AS (SELECT DISTINCT conv_id, quote, turn AS ref, true AS hit FROM h)
       SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE quote <> '' AND coalesce(hit, false)) AS valid, count(*) FILTER (WHERE coalesce(places, 0) > 1) AS ambiguous
       FROM e LEFT JOIN p USING (conv_id, quote) LEFT JOIN a USING (conv_id, quote, ref) GROUP BY conv_id""",
)
def q42_citations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    rows = turns.select(F.col("conv_id").alias("bundle_id"), F.lit("turn").alias("source"), F.col("turn").alias("ref"), "text")
    ref = F.when(F.col("ref") % 3 == 0, F.col("ref") + 1).otherwise(F.col("ref"))
    cited = rows.select("bundle_id", "source", ref.alias("ref"), scalars.squeezed(F.col("text")).alias("quote"), F.lit(False).alias("auto"))
    checked = citations.verify_citations(cited, rows, least=1, most_places=1)
    return checked.groupBy(F.col("bundle_id").alias("conv_id")).agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.count_if("ambiguous").alias("ambiguous"))
