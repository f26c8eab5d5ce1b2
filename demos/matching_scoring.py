"""Matching of wordings, and scoring of labels, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall import values as V
from rollcall.functions import decide, replies, text
from rollcall.operators import joins as J
from rollcall.operators import scoring
from rollcall.operators.matching import leader_cluster
from rollcall.operators.ranking import to_batches
from rollcall.plans import evaluation

from .cleaning import RULES_SQL
from .registry import query

SCORE = """CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::double ELSE greatest(o / u::double,
  CASE WHEN least(len(a), len(b)) >= 2 THEN 0.9::double * o / least(len(a), len(b)) ELSE 0 END) END"""


@query(f"""
SELECT name_a, name_b, {SCORE} AS score FROM (SELECT *, len(list_intersect(a, b)) AS o, len(a) + len(b) - len(list_intersect(a, b)) AS u
  FROM (SELECT DISTINCT p_name AS name_a, lower(o) AS name_b, string_split(p_name, ' ') AS a, string_split(lower(o), ' ') AS b
    FROM (SELECT p_name, p_type || ' ' || split_part(p_name, ' ', 2) || ' ' || split_part(p_brand, '#', 1) AS o FROM part)))""")
def word_similarity(t):
    other = F.lower(F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", -1), F.substring_index("p_brand", "#", 1)))
    pairs = t.part.select(F.col("p_name").alias("name_a"), other.alias("name_b")).distinct()
    score = text.title_similarity(text.word_set("name_a"), text.word_set("name_b"))
    return pairs.select("name_a", "name_b", score.alias("score"))


@query("""
WITH RECURSIVE r AS (
  SELECT p_partkey, p_brand || '/' || p_type AS block, string_split(p_name, ' ') AS w,
    row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part
), step AS (
  SELECT block, k, p_partkey, [w] AS heads, 1::bigint AS mine FROM r WHERE k = 1
  UNION ALL
  SELECT block, k, p_partkey, CASE WHEN best >= 0.4 THEN heads ELSE list_append(heads, w) END,
    CASE WHEN best >= 0.4 THEN list_position(scores, best) ELSE len(heads) + 1 END
  FROM (SELECT *, list_max(scores) AS best FROM (SELECT r.block, r.k, r.p_partkey, r.w, s.heads,
      list_transform(s.heads, lambda h: greatest(
        len(list_intersect(h, r.w)) / (len(h) + len(r.w) - len(list_intersect(h, r.w)))::double,
        0.9::double * len(list_intersect(h, r.w)) / 2)) AS scores
    FROM step s JOIN r ON r.block = s.block AND r.k = s.k + 1))
)
SELECT p_partkey, block || '|' || mine AS proposal_id FROM step""")
def leader_clusters(t):
    parts = t.part.select(
        "p_partkey", "p_retailprice", F.concat_ws("/", "p_brand", "p_type").alias("block"), text.word_set("p_name").alias("words")
    )
    order = [-F.col("p_retailprice"), F.col("p_partkey")]
    return leader_cluster(parts, "block", "words", order, threshold=0.4).select("p_partkey", "proposal_id")


# Labels: 1 is "supports", 0 is "opposes"; predictions come from the length and language of the text.

GOLD = """
  SELECT d.doc_id::varchar AS id, lang AS company, source AS title, CASE quality WHEN 1 THEN 'supports' ELSE 'opposes' END AS label,
    CASE WHEN n_chars % 5 = 0 THEN 'unclear' WHEN n_chars > 600 THEN 'supports' ELSE 'opposes' END AS rule_label,
    CASE WHEN ('0x' || substr(md5(d.doc_id::varchar), 1, 8))::bigint % 100 < 30 THEN 'dev' ELSE 'test' END AS split, toxic, n_chars
  FROM documents d JOIN labels USING (doc_id)"""
SAID = f"""
  SELECT * FROM (SELECT 'Keyword rules' AS system, id, company, title, label, rule_label AS said FROM gold WHERE split = 'test'
  UNION ALL SELECT 'm / v1', id, company, title, label, v1 FROM gold WHERE split = 'test'
  UNION ALL SELECT 'Rules, then v1 where rules are unclear', id, company, title, label,
    CASE WHEN rule_label = 'unclear' THEN v1 ELSE rule_label END FROM gold WHERE split = 'test')"""
GOLD_CTE = f"WITH gold AS (SELECT *, CASE WHEN n_chars % 7 = 0 THEN 'no answer' WHEN toxic = 1 THEN 'opposes' ELSE 'supports' END AS v1 FROM ({GOLD})), said AS ({SAID})"


def _gold(t):
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("company"),
        F.col("source").alias("title"),
        F.when(F.col("quality") == 1, "supports").otherwise("opposes").alias("label"),
        F.expr("CASE WHEN n_chars % 5 = 0 THEN 'unclear' WHEN n_chars > 600 THEN 'supports' ELSE 'opposes' END").alias("rule_label"),
        replies.hash_split("doc_id").alias("split"),
        "toxic",
        "n_chars",
    )


def _systems(t):
    gold = _gold(t)
    v1 = "CASE WHEN n_chars % 7 = 0 THEN 'no answer' WHEN toxic = 1 THEN 'opposes' ELSE 'supports' END AS label"
    complete = gold.selectExpr("'m__v1' AS run", "id", v1)
    # A run that has not answered everything is not scored.
    partial = gold.filter("toxic = 0").selectExpr("'m__v2' AS run", "id", "'supports' AS label")
    return evaluation.systems(gold.drop("toxic", "n_chars"), complete.unionByName(partial), "test")


def _rate(part: str, whole: str) -> str:
    return f"round_even(({part}) / nullif({whole}, 0)::double * 100 * 10, 0) / 10"


@query(GOLD_CTE + f"""
SELECT system, count(*) AS proposals, {_rate("sum((said = label)::integer)", "count(*)")} AS accuracy,
  {", ".join(
      f"{_rate(f'''count(*) FILTER (WHERE said = '{w}' AND label = '{w}')''', f'''count(*) FILTER (WHERE {side} = '{w}')''')} AS {w}_{name}"
      for w in V.SCORED_LABELS for side, name in (("said", "precision"), ("label", "recall")))},
  {_rate("count(*) FILTER (WHERE said NOT IN ('supports', 'opposes'))", "count(*)")} AS no_clear_answer
FROM said GROUP BY system""")
def score_labels(t):
    return evaluation.scores(_systems(t))


@query(GOLD_CTE + """
SELECT system, label AS truth, count(*) FILTER (WHERE said = 'supports') AS supports, count(*) FILTER (WHERE said = 'opposes')
  AS opposes, count(*) FILTER (WHERE said = 'unclear') AS unclear, count(*) FILTER (WHERE said = 'no answer') AS "no answer"
FROM said GROUP BY 1, 2""")
def label_confusion(t):
    return evaluation.confusion(_systems(t))


NAMES = ["Keyword rules", "m / v1"]


@query(GOLD_CTE + """
SELECT id, company, title, label, rule_label AS "Keyword rules", v1 AS "m / v1" FROM gold
WHERE split = 'test' AND (rule_label <> label OR v1 <> label)""")
def any_system_wrong(t):
    return evaluation.errors(_systems(t), NAMES)


@query(GOLD_CTE + """
SELECT id, CASE WHEN rule_label = 'unclear' THEN v1 ELSE rule_label END AS said FROM gold""")
def hybrid_label(t):
    v1 = F.expr("CASE WHEN n_chars % 7 = 0 THEN 'no answer' WHEN toxic = 1 THEN 'opposes' ELSE 'supports' END")
    return _gold(t).select("id", decide.hybrid("rule_label", v1).alias("said"))


@query(f"""
SELECT lang, direction, count(*) AS proposals, sum((quality = 1)::integer)::bigint AS good FROM ({RULES_SQL})
JOIN documents USING (doc_id) JOIN labels USING (doc_id) GROUP BY 1, 2""")
def rules_against_labels(t):
    docs = J.with_parent(t.documents.select("doc_id", "lang", "text"), t.labels.select("doc_id", "quality"), "doc_id")
    return docs.groupBy("lang", text.rule_label("text").alias("direction")).agg(
        F.count(F.lit(1)).alias("proposals"), F.count_if(F.col("quality") == 1).alias("good")
    )


@query("""
SELECT floor((r - 1) / 15)::bigint AS batch, count(*) AS asked,
  '[' || string_agg('{"id":"' || id || '","company":"' || lang || '","title":"' || source || '"}', ',' ORDER BY r) || ']' AS payload
FROM (SELECT lpad(doc_id::varchar, 12, '0') AS id, lang, source, row_number() OVER (ORDER BY doc_id) AS r FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY 1""")
def json_batches(t):
    todo = J.todo(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"),
        F.col("lang").alias("company"),
        F.col("source").alias("title"),
    )
    return to_batches(todo, [F.col("id")], 15, ["id", "company", "title"], "id")


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN [] ELSE
  CASE WHEN (props->>'k')::integer % 3 = 0 THEN [{'id': event_id::varchar, 'label': 'supports'}]
    WHEN (props->>'k')::integer % 3 = 1 THEN [{'id': event_id::varchar, 'label': 'opposes'}, {'id': (props->>'k'), 'label': 'unclear'}]
    ELSE [] END END AS x FROM events""".replace("SELECT event_id, CASE", "SELECT event_id, len(x) AS n, x[1].id AS id, x[1].label AS label FROM (SELECT event_id, CASE", 1) + ")")
def json_labels(t):
    """Replies built around the JSON of each event: clean ones, ones with text around them, and broken ones."""
    reply = F.expr(
        "CASE WHEN event_id % 4 = 0 THEN concat('Sorry { ', props)"
        " ELSE concat('Here: {\"labels\": [', CASE k % 3"
        "   WHEN 0 THEN concat('{\"id\": ', event_id, ', \"label\": \" Supports\"}')"
        "   WHEN 1 THEN concat('{\"id\": \"', event_id, '\", \"label\": \"OPPOSES\"}, {\"id\": ', k, ', \"label\": \"unclear\"}')"
        "   ELSE concat('{\"id\": ', k, ', \"label\": \"yes\"}, {\"label\": \"opposes\"}') END, ']} bye') END"
    )
    said = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).select(
        "event_id", replies.parse_labels(reply).alias("x")
    )
    first = F.try_element_at("x", F.lit(1))
    return said.select(
        "event_id", F.size("x").cast("long").alias("n"), first["id"].alias("id"), first["label"].alias("label")
    )


@query("""
SELECT d.doc_id, coalesce(CASE quality WHEN 1 THEN 'supports' WHEN 0 THEN 'opposes' END, 'no answer') AS label
FROM documents d LEFT JOIN labels USING (doc_id)""")
def recorded_answers(t):
    said = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "supports").otherwise("opposes").alias("label"))
    return evaluation.record_answers(t.documents.select(F.col("doc_id").alias("id")), said).withColumnRenamed("id", "doc_id")


@query("""
SELECT run, answered, answered = (SELECT count(*) FROM documents) AS complete FROM (
  SELECT 'labels' AS run, count(*) AS answered FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'rules', count(*) FROM documents)""")
def run_coverage(t):
    runs = t.labels.select(F.lit("labels").alias("run"), "doc_id").unionByName(
        t.documents.select(F.lit("rules").alias("run"), "doc_id")
    )
    return J.covers(t.documents, runs, "run", "doc_id")


@query("""
SELECT lang, count(*) AS proposals, sum((said = truth)::integer) / count(*)::double AS accuracy,
  sum((said = 1 AND truth = 1)::integer) / nullif(sum((said = 1)::integer), 0)::double AS "1_precision",
  sum((said = 1 AND truth = 1)::integer) / nullif(sum((truth = 1)::integer), 0)::double AS "1_recall",
  sum((said <> 1)::integer) / count(*)::double AS no_clear_answer
FROM (SELECT lang, quality AS truth, (n_chars > 500)::integer AS said FROM documents JOIN labels USING (doc_id)) GROUP BY lang""")
def binary_metrics(t):
    rows = t.documents.join(t.labels, "doc_id").select(
        "lang", F.col("quality").alias("truth"), (F.col("n_chars") > 500).cast("int").alias("said")
    )
    return scoring.binary_metrics(rows, ["lang"], "truth", "said", [1])
