"""Deterministic views over the driver's tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LETTERS = ["A", "B", "C", "D"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))


def options(spark: SparkSession, d: str, text: Column | str = "text") -> DataFrame:
    """id, source, qn, topic_id, letter, text, score, is_golden, doc_id, n_chars, target: four documents of a source make a question.

    Where a source's last question lacks documents, the source's first ones fill it. Targets are all benchmark items in turn.
    text: what of a document's text is carried, which its windows and joins move whole otherwise.
    """
    docs = table(spark, d, "documents").withColumn("text", F.col(text) if isinstance(text, str) else text).select("doc_id", "source", "n_chars", "text")
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rn = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long")
    df = docs.withColumn("rn", rn).withColumn("n", F.count("*").over(Window.partitionBy("source")))
    places = F.when(F.col("rn") < F.pmod(-F.col("n"), F.lit(4)), F.array("rn", F.col("rn") + F.col("n"))).otherwise(F.array("rn"))
    df = df.withColumn("rn", F.explode(places)).withColumn("qn", F.floor(F.col("rn") / 4).cast("int"))
    df = df.withColumn("n", F.count("*").over(Window.partitionBy("source", "qn"))).where("n = 4")
    df = df.join(labels, "doc_id", "left").withColumn("score", (F.col("quality") * 2 + 1 - F.col("toxic")).cast("int"))
    letter = F.element_at(F.array(*[F.lit(x) for x in LETTERS]), (F.col("rn") % 4 + 1).cast("int"))
    target = table(spark, d, "benchmark").select(F.col("item_id").alias("target_id"), F.col("text").alias("target"))
    n_targets = target.agg((F.max("target_id") + 1).alias("n_targets"))
    df = df.crossJoin(F.broadcast(n_targets)).withColumn("target_id", (F.col("qn") % F.col("n_targets")).cast("long")).join(target, "target_id", "left")
    return df.select(
        F.concat_ws("_", "source", "qn").alias("id"), "source", "qn", (F.col("qn") * 100 + F.substring("source", 4, 9).cast("int")).cast("long").alias("topic_id"), letter.alias("letter"),
        "text", "score", F.coalesce(F.col("score") >= 2, F.lit(False)).alias("is_golden"), "doc_id", "n_chars", F.coalesce("target", F.lit("")).alias("target_event"),
    )


def questions(spark: SparkSession, d: str, text: Column | str = "text") -> DataFrame:
    """The flat form, with asset, event_date, split, golden_answer, causal_strength and option_types."""
    o = options(spark, d, text)
    first = lambda x, c: F.max(F.when(F.col("letter") == x, F.col(c)))
    kind = F.when(F.col("score") >= 2, "correct").when(F.col("score") == 1, "background").otherwise("unrelated")
    q = o.withColumn("kind", kind).groupBy("id", "source", "qn", "topic_id", "target_event").agg(
        *[first(x, "text").alias(f"option_{x}") for x in LETTERS],
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_golden"), F.col("letter")))), ",").alias("golden_answer"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", "score")))).alias("causal_strength"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", "kind")))).alias("option_types"),
        F.sum("n_chars").alias("chars"),
    )
    split = F.when(F.col("qn") % 10 < 6, "train").when(F.col("qn") % 10 < 8, "dev").otherwise("test")
    return q.withColumn("asset", F.col("source")).withColumn("event_date", F.date_add(F.lit("2023-01-01").cast("date"), F.floor(F.col("qn") / 2).cast("int"))).withColumn("split", split)


def candidates(spark: SparkSession, d: str, text: Column | str = "text") -> DataFrame:
    """Options as scored candidates of their topic: ord, consensus, position, and the event's date."""
    o = options(spark, d, text)
    ord_ = F.ascii("letter") - 65
    position = F.when(F.col("doc_id") % 11 == 0, "after").when(F.col("doc_id") % 7 == 0, "unknown").otherwise("before")
    return o.select(
        F.col("source").alias("asset"), "topic_id", ord_.alias("ord"), "text", "doc_id", "score", F.when(F.col("score") >= 2, F.col("score")).otherwise(F.col("score")).alias("consensus"),
        position.alias("position"), F.date_add(F.lit("2023-01-01").cast("date"), F.floor(F.col("qn") / 2).cast("int")).alias("event_date"), "target_event",
    )


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Three raters of every labelled document; the third leaves some out."""
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars", "source"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = F.array(
        F.struct(F.lit("m1").alias("model"), (F.col("quality") * 3).cast("int").alias("score")),
        F.struct(F.lit("m2").alias("model"), ((1 - F.col("toxic")) * 3).cast("int").alias("score")),
        F.struct(F.lit("m3").alias("model"), F.when(F.col("n_chars") % 5 != 0, (F.col("n_chars") % 4).cast("int")).alias("score")),
    )
    df = docs.join(labels, "doc_id").select("doc_id", "source", F.explode(rows).alias("r"))
    return df.select(F.col("doc_id").alias("item"), F.expr("cast(substring(source, 4) as bigint)").alias("topic_id"), F.col("doc_id").alias("ord"), "r.model", "r.score")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """pred and gold letter arrays of two models per question."""
    q = questions(spark, d)
    bits = lambda x: F.filter(F.transform(F.array(*[F.lit(c) for c in LETTERS]), lambda c, i: F.when(F.expr("1").isNotNull() & (F.getbit(x, i) == 1), c)), lambda c: c.isNotNull())
    gold = F.filter(F.split("golden_answer", ","), lambda x: x != "")
    rows = F.explode(F.array(F.struct(F.lit("m1").alias("model"), bits(F.col("chars") % 16).alias("pred")), F.struct(F.lit("m2").alias("model"), bits(F.floor(F.col("chars") / 16) % 16).alias("pred")))).alias("r")
    return q.select("id", "asset", gold.alias("gold"), rows).select("r.model", "id", "asset", "r.pred", "gold")


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Pages as search hits."""
    source = F.when(F.col("page_id") % 4 == 0, "www.reuters.com").when(F.col("page_id") % 4 == 1, "uk.finance.yahoo.com").when(F.col("page_id") % 4 == 2, "notbbc.co.uk").otherwise("blog.example.net")
    title = F.when(F.col("page_id") % 5 == 0, "Gold rate today in Pune").when(F.col("page_id") % 5 == 1, "Fed raises rates").when(F.col("page_id") % 5 == 2, "22 carat gold per tola").otherwise("Bank fails")
    language = F.when(F.col("page_id") % 6 == 0, "German").when(F.col("page_id") % 6 == 1, "").otherwise("English")
    return table(spark, d, "pages").select(
        (F.col("page_id") % 9).alias("topic"), (F.col("page_id") % 9).alias("search_id"), (F.col("page_id") % 3).cast("int").alias("query_ord"), F.col("page_id").cast("int").alias("rank"),
        "page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("url"), source.alias("source"), title.alias("title"), language.alias("language"),
    )


def topic_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("topic"), F.col("doc_id").alias("ord"), F.col("text").alias("content"), "source", "n_chars")


#: The same views for the oracle.
SQL = r"""
WITH prices_v AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2),
labels_v AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
placed_v AS (SELECT doc_id, source, n_chars, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY source) AS k FROM documents),
numbered_v AS (SELECT doc_id, source, n_chars, text, rn FROM placed_v UNION ALL SELECT doc_id, source, n_chars, text, rn + k FROM placed_v WHERE rn < (4 - k % 4) % 4),
options_v AS (
  SELECT n.source || '_' || (n.rn // 4) AS id, n.source, CAST(n.rn // 4 AS INTEGER) AS qn, CAST((n.rn // 4) * 100 + CAST(substring(n.source, 4) AS INTEGER) AS BIGINT) AS topic_id,
    chr(CAST(65 + n.rn % 4 AS INTEGER)) AS letter, n.text, CAST(l.quality * 2 + 1 - l.toxic AS INTEGER) AS score, coalesce(l.quality * 2 + 1 - l.toxic >= 2, false) AS is_golden,
    n.doc_id, n.n_chars, coalesce(b.text, '') AS target_event
  FROM (SELECT *, count(*) OVER (PARTITION BY source, rn // 4) AS n FROM numbered_v) n
  LEFT JOIN labels_v l ON n.doc_id = l.doc_id LEFT JOIN benchmark b ON b.item_id = (n.rn // 4) % (SELECT max(item_id) + 1 FROM benchmark) WHERE n.n = 4),
questions_v AS (
  SELECT id, source, qn, topic_id, target_event, source AS asset, CAST(DATE '2023-01-01' + CAST(qn // 2 AS INTEGER) AS DATE) AS event_date,
    CASE WHEN qn % 10 < 6 THEN 'train' WHEN qn % 10 < 8 THEN 'dev' ELSE 'test' END AS split,
    max(text) FILTER (WHERE letter = 'A') AS option_A, max(text) FILTER (WHERE letter = 'B') AS option_B, max(text) FILTER (WHERE letter = 'C') AS option_C, max(text) FILTER (WHERE letter = 'D') AS option_D,
    coalesce(string_agg(letter, ',' ORDER BY letter) FILTER (WHERE is_golden), '') AS golden_answer, CAST(sum(n_chars) AS BIGINT) AS chars
  FROM options_v GROUP BY ALL),
candidates_v AS (
  SELECT source AS asset, topic_id, ascii(letter) - 65 AS ord, text, doc_id, score, score AS consensus, target_event,
    CASE WHEN doc_id % 11 = 0 THEN 'after' WHEN doc_id % 7 = 0 THEN 'unknown' ELSE 'before' END AS position, CAST(DATE '2023-01-01' + CAST(qn // 2 AS INTEGER) AS DATE) AS event_date FROM options_v),
ratings_v AS (
  SELECT d.doc_id AS item, CAST(substring(d.source, 4) AS BIGINT) AS topic_id, d.doc_id AS ord, m.model,
    CASE m.model WHEN 'm1' THEN l.quality * 3 WHEN 'm2' THEN (1 - l.toxic) * 3 ELSE CASE WHEN d.n_chars % 5 <> 0 THEN d.n_chars % 4 END END AS score
  FROM documents d JOIN labels_v l ON d.doc_id = l.doc_id, (VALUES ('m1'), ('m2'), ('m3')) m(model)),
preds_v AS (
  SELECT m.model, q.id, q.asset, list_filter(['A', 'B', 'C', 'D'], lambda x: (q.chars // m.d) % 16 // CAST(pow(2, ascii(x) - 65) AS BIGINT) % 2 = 1) AS pred,
    list_filter(string_split(q.golden_answer, ','), lambda x: x <> '') AS gold
  FROM questions_v q, (VALUES ('m1', 1), ('m2', 16)) m(model, d)),
metrics_v AS (
  SELECT *, len(list_intersect(pred, gold)) AS tp, len(pred) AS np, len(gold) AS ng FROM preds_v),
results_v AS (
  SELECT model, id, asset, pred, gold, CAST(tp = np AND tp = ng AS INTEGER) AS exact_match, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS precision, CASE WHEN ng = 0 THEN 0 ELSE tp / ng END AS recall,
    CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (np + ng) END AS f1, np AS n_pred, ng AS n_gold, ng - tp AS under_selected, np - tp AS over_selected FROM metrics_v),
hits_v AS (
  SELECT page_id % 9 AS topic, page_id % 9 AS search_id, CAST(page_id % 3 AS INTEGER) AS query_ord, CAST(page_id AS INTEGER) AS rank, page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS url,
    CASE page_id % 4 WHEN 0 THEN 'www.reuters.com' WHEN 1 THEN 'uk.finance.yahoo.com' WHEN 2 THEN 'notbbc.co.uk' ELSE 'blog.example.net' END AS source,
    CASE page_id % 5 WHEN 0 THEN 'Gold rate today in Pune' WHEN 1 THEN 'Fed raises rates' WHEN 2 THEN '22 carat gold per tola' ELSE 'Bank fails' END AS title,
    CASE page_id % 6 WHEN 0 THEN 'German' WHEN 1 THEN '' ELSE 'English' END AS language FROM pages),
topic_docs_v AS (SELECT lang AS topic, doc_id AS ord, text AS content, source, n_chars FROM documents),
returns_v AS (SELECT *, CASE WHEN close > 0 AND prev > 0 THEN ln(close / prev) END AS ret FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY date) AS prev FROM prices_v)),
zscores_v AS (
  SELECT *, CASE WHEN sigma = 0 THEN NULL ELSE ret / sigma END AS z FROM (SELECT *, CASE WHEN count(ret) OVER w >= 30 THEN stddev_samp(ret) OVER w END AS sigma FROM returns_v
  WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING))),
products_v AS (SELECT *, abs(ret) * abs(lag(ret) OVER (PARTITION BY asset ORDER BY date)) AS ap FROM returns_v),
bipower_v AS (
  SELECT *, CASE WHEN count(ap) OVER w = 14 THEN sqrt(sum(ap) OVER w / 14) END AS sigma FROM products_v WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
jumps_v AS (
  SELECT *, sqrt(2 * ln(n_obs)) / sqrt(2 / pi()) - (ln(pi()) + ln(ln(n_obs))) / (2 * sqrt(2 / pi()) * sqrt(2 * ln(n_obs))) - ln(-ln(1 - 0.01)) / (sqrt(2 / pi()) * sqrt(2 * ln(n_obs))) AS threshold
  FROM (SELECT *, count(l) OVER (PARTITION BY asset) AS n_obs FROM (SELECT *, ret / sigma AS l FROM bipower_v)))
"""
