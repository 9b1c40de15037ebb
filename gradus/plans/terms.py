"""Registered queries over text quality, terms, levels and concepts, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import detectors as D
from gradus.functions import lexicons as L
from gradus.functions import quality as Q
from gradus.functions import scoring as G
from gradus.functions import similarity as S
from gradus.functions import text as T
from gradus.operators import alignment as N
from gradus.operators import terms as W
from gradus.sources.tables import spread, table

from .text import PAIRS, STOP, TURNS, _kind, div, hits, pairs, q, r6, sents, strip, turns, w

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"""SELECT doc_id, round(CASE WHEN text = '' THEN 0 ELSE greatest(0.0, 1.0 - CASE WHEN len(regexp_extract_all(text, {q(Q.NOISE)})) > length(text) * 0.1 THEN 0.2 ELSE 0 END - CASE WHEN len(regexp_extract_all(text, {q(Q.REPEATED)})) > 5 THEN 0.15 ELSE 0 END
 - CASE WHEN len({w("regexp_replace(text, '[.!?]', ' ', 'g')")})::DOUBLE / len(string_split_regex(text, '[.!?]')) BETWEEN 3 AND 50 THEN 0 ELSE 0.1 END - CASE WHEN contains(text, chr(10)) THEN 0 ELSE 0.05 END) END::DOUBLE, 6) AS quality FROM documents WHERE text IS NOT NULL""")
def text_quality(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).filter("text IS NOT NULL").select("doc_id", r6(Q.quality_score(F.col("text"))).alias("quality"))


@query(f"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\n', chr(10) || '2) '), '({Q.QUESTION})', chr(1) || '\\1', 'g'), chr(1)), lambda p: {strip('p')}), lambda p: p <> '') AS ps FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, len(ps) AS parts, list_transform(ps, lambda p: length(p)) AS lengths FROM x""")
def question_parts(spark, d):
    """Documents, with a question marker before their second line, cut at the markers that stand at line starts."""
    x = table(spark, d, "documents").filter("text IS NOT NULL")
    marked = F.when(F.instr("text", "\n") > 0, F.concat(F.substring_index("text", "\n", 1), F.lit("\n2) "), F.expr("substr(text, instr(text, '\n') + 1)"))).otherwise(F.col("text"))
    return x.select("doc_id", Q.question_parts(marked).alias("ps")).select("doc_id", F.size("ps").alias("parts"), F.transform("ps", F.char_length).alias("lengths"))


@query(f"""SELECT doc_id, list_filter(found, lambda e, i: list_position(found, e) = i) AS entities FROM (SELECT doc_id, regexp_extract_all(text, '{Q.ENTITY}') AS found FROM documents)""")
def named_entities(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.entities(F.col("text")).alias("entities"))


@query(f"SELECT doc_id, array_to_string(list_filter({w('text')}, lambda x: regexp_matches(x, '^[\\p{{L}}\\p{{N}}]+$') AND NOT list_contains({STOP}, x)), ' ') AS normal FROM documents")
def normal_forms(spark, d):
    """Normalised texts, without a map of lemmas."""
    return table(spark, d, "documents").select("doc_id", Q.normal_form(F.col("text")).alias("normal"))


@query(f"""SELECT conv_id, turn, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) + len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) AS changed FROM (SELECT conv_id, turn, {w('student')} AS a, {w('model')} AS b FROM ({TURNS}))""")
def changed_words(spark, d):
    return turns(spark, d).select("conv_id", "turn", Q.changed_words(F.col("student"), F.col("model")).alias("changed"))


_TOKENS = "list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


@query(f"""WITH x AS (SELECT conv_id, turn, {_TOKENS.format(x='student')} AS s, {_TOKENS.format(x='model')} AS m FROM ({TURNS})), y AS (SELECT conv_id, turn, list_filter(m, lambda t, i: list_position(m, t) = i AND NOT list_contains(s, t)) AS a, list_transform(list_filter(m, lambda t, i: list_position(m, t) = i), lambda t: translate(t, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS b FROM x),
 z AS (SELECT conv_id, turn, a, list_filter(b, lambda t: NOT list_contains(list_transform(a, lambda k: lower(k)), lower(t))) AS c FROM y)
 SELECT conv_id, turn, list_concat(a, list_filter(c, lambda t, i: list_position(list_transform(c, lambda k: lower(k)), lower(t)) = i)) AS missing FROM z""")
def merged_missing(spark, d):
    """Missing words of two lists, the model's words that the answer lacks and all of the model's in capitals, united whatever the case."""
    tokens = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda t: t != "")
    x = turns(spark, d).select("conv_id", "turn", F.array_except(tokens("model"), tokens("student")).alias("a"), F.transform(F.array_distinct(tokens("model")), lambda t: F.translate(t, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("b"))
    return x.select("conv_id", "turn", Q.merged_missing(F.col("a"), F.col("b")).alias("missing"))


@query(f"""SELECT conv_id, turn, line, substr(t, 1, 120) AS text, len({w('t')}) AS words, t = '' AS empty FROM (SELECT conv_id, turn, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM (SELECT conv_id, turn, list_transform(string_split({strip('text')}, chr(10)), lambda l: {strip('l')}) AS ls FROM conversations))""")
def line_quality(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", F.explode(Q.lines_of(F.col("text"))).alias("l"))
    return x.select("conv_id", "turn", "l.*")


_COUNTS = ", ".join(f"({' + '.join(hits('student', p) for p in group)})" for group in L.ANSWER_CUES)


@query(f"""WITH h AS (SELECT conv_id, turn, [{_COUNTS}] AS cs FROM ({TURNS})) SELECT conv_id, turn, level, [{', '.join(q(n) for n in L.LEVELS)}][level] AS name, cs[level] AS hits, round({div('cs[level]', 'list_sum(cs)')}, 3) AS confidence FROM h, (SELECT unnest(range(1, 7)) AS level)""")
def level_breakdown(spark, d):
    counts = D.cue_counts(F.col("cue"), L.ANSWER_CUES)
    x = turns(spark, d).withColumn("cue", T.edged(F.col("student"))).select("conv_id", "turn", F.explode(Q.level_breakdown(counts, L.LEVELS)).alias("l"))
    return x.select("conv_id", "turn", "l.*")


_TERM = f"list_filter(regexp_extract_all(lower(coalesce({{x}}, '')), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}'), lambda t: NOT list_contains({STOP}, t))"


def _terms(rows: str, x: str, longest: int = 2) -> str:
    """rows with the terms of the text x as `terms`; its words are computed once."""
    runs = [f"list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))" for n in range(2, longest + 1)]
    return f"SELECT *, flatten([{', '.join(['ws', *runs])}]) AS terms FROM (SELECT *, {_TERM.format(x=x)} AS ws FROM ({rows}))"


_TFIDF = f"""t AS (SELECT doc_id, unnest(terms) AS term, side FROM (SELECT doc_id, terms, 0 AS side FROM ({_terms(PAIRS, 'model')}) UNION ALL SELECT doc_id, terms, 1 FROM ({_terms(PAIRS, 'student')}))),
 n AS (SELECT doc_id, term, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM t GROUP BY ALL), i AS (SELECT *, pow(ln(3.0 / (1 + CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER))) + 1, 2) AS w FROM n),
 c AS (SELECT doc_id, sum(w * a * b) / nullif(sqrt(sum(w * a * a)) * sqrt(sum(w * b * b)), 0) AS tfidf FROM i GROUP BY 1)"""


@query(f"""WITH {_TFIDF}, x AS (SELECT doc_id, list_distinct({w('student')}) AS s, list_distinct({w('model')}) AS m FROM ({PAIRS})), y AS (SELECT doc_id, {div('len(list_intersect(s, m))', 'least(len(s), len(m))')} AS semantic, {div('len(list_intersect(s, m))', 'len(list_distinct(list_concat(s, m)))')} AS jaccard FROM x)
 SELECT doc_id, round(coalesce(tfidf, 0), 6) AS tfidf, round(0.6 * semantic + 0.25 * coalesce(tfidf, 0) + 0.15 * jaccard, 6) AS hybrid FROM y LEFT JOIN c USING (doc_id)""")
def hybrid_similarity(spark, d):
    """Word overlap (for meaning), tf-idf of the pair and Jaccard, weighted."""
    x = pairs(spark, d).withColumns({"s": F.array_distinct(T.words(F.col("student"))), "m": F.array_distinct(T.words(F.col("model"))), "a": W.terms(F.col("model")), "b": W.terms(F.col("student"))})
    x = x.select("doc_id", "a", "b", S.overlap_smaller(F.col("s"), F.col("m")).alias("semantic"), S.jaccard(F.col("s"), F.col("m")).alias("jaccard"))
    x = W.with_cosine(x, "tfidf", "a", "b")
    return x.select("doc_id", r6(F.col("tfidf")).alias("tfidf"), r6(Q.hybrid(F.col("semantic"), F.col("tfidf"), F.col("jaccard"))).alias("hybrid"))


SQL["tfidf_pairs"] = f"WITH {_TFIDF} SELECT doc_id, round(coalesce(tfidf, 0), 6) AS similarity FROM documents LEFT JOIN c USING (doc_id)"


@query(f"""WITH t AS (SELECT doc_id, unnest(terms) AS term FROM ({_terms('SELECT doc_id, text FROM documents', 'text')})), n AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL), l AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM n GROUP BY 1)
 SELECT doc_id, term, round(n / norm, 6) AS weight, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS place FROM n) JOIN l USING (doc_id) WHERE place <= 10""")
def important_terms(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return W.important_terms(docs, "doc_id", F.col("text")).withColumn("weight", r6(F.col("weight")))


@query(f"""WITH s AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS place FROM (SELECT doc_id, {sents('text', 2)} AS ss FROM documents)), z AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1), t AS (SELECT doc_id, place, unnest(terms) AS term FROM ({_terms('SELECT * FROM s', 's')})),
 n AS (SELECT doc_id, place, term, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT doc_id, term, count(*) AS df FROM n GROUP BY ALL), v AS (SELECT doc_id, place, n * (ln((1 + k) / (1 + df)) + 1) AS w FROM n JOIN f USING (doc_id, term) JOIN z USING (doc_id)),
 o AS (SELECT doc_id, place, sum(w) / sqrt(sum(w * w)) AS mean FROM v GROUP BY ALL), m AS (SELECT doc_id, max(mean) AS top FROM o GROUP BY 1)
 SELECT doc_id, place, round(CASE WHEN k < 2 OR top IS NULL THEN 1.0 ELSE coalesce(mean, 0) / top * 2 END::DOUBLE, 6) AS salience FROM s JOIN z USING (doc_id) LEFT JOIN o USING (doc_id, place) LEFT JOIN m USING (doc_id)""")
def sentence_salience(spark, d):
    x = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.transform(T.sentences(F.col("text"), 2), lambda s: W.terms(s)).alias("ts"))
    return W.with_salience(x, "salience", "ts").select("doc_id", F.posexplode("salience").alias("place", "salience")).withColumn("salience", r6(F.col("salience")))


_CAPS = "SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}(?: [a-z]{4,}){0,2}'))) AS concept FROM documents"


def _runs_of(n: int) -> str:
    return f"SELECT doc_id, concept, array_to_string(ws[i:i + {n - 1}], ' ') AS term, 1.5 AS times FROM (SELECT doc_id, concept, string_split(concept, ' ') AS ws, unnest(range(1, len(string_split(concept, ' ')) - {n - 2})) AS i FROM p)"


@query(f"""WITH p AS ({_CAPS}), t AS (SELECT doc_id, unnest(terms) AS term FROM ({_terms('SELECT doc_id, text FROM documents', 'text', 3)})), n AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL), l AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM n GROUP BY 1),
 h AS (SELECT doc_id, concept, unnest(string_split(concept, ' ')) AS term, 1.0 AS times FROM p UNION ALL {_runs_of(2)} UNION ALL {_runs_of(3)}), s AS (SELECT doc_id, concept, sum(times * n / norm) AS s FROM h JOIN n USING (doc_id, term) JOIN l USING (doc_id) GROUP BY ALL),
 g AS (SELECT doc_id, concept, greatest(coalesce(s, 0), 0.1) AS s FROM p LEFT JOIN s USING (doc_id, concept)), k AS (SELECT doc_id, concept, greatest(0.1, s / max(s) OVER (PARTITION BY doc_id)) AS importance FROM g)
 SELECT doc_id, count(*) AS nodes, round(sum(importance), 4) AS importance, round(min(importance), 4) AS least FROM k GROUP BY 1""")
def concept_graph(spark, d):
    """Concepts of each document (capitalised words with up to two words after them), ranked by the weight of their words, and the nodes that they make."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    found = F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,}(?: [a-z]{4,}){0,2})"), F.lit(1))
    ranked = W.ranked_concepts(docs, "doc_id", found, F.col("text"))
    nodes = W.graph_nodes(ranked, "doc_id", "concept", "importance")
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.round(F.sum("importance"), 4).alias("importance"), F.round(F.min("importance"), 4).alias("least"))


@query("""SELECT l_orderkey, count(*) AS nodes, count(*) FILTER (l_discount * 10 >= 0.55) AS covered, count(*) FILTER (l_discount * 10 >= 0.35 AND l_discount * 10 < 0.55) AS partial, count(*) FILTER (l_discount * 10 < 0.35) AS missing, round(sum(l_quantity * l_discount * 10), 4) AS covered_importance FROM lineitem GROUP BY 1""")
def graph_summary(spark, d):
    """Lines of an order as concepts: the quantity is the importance, ten times the discount the match."""
    x = table(spark, d, "lineitem").withColumn("match", F.col("l_discount") * 10)
    return W.graph_summary(x, "l_orderkey", "l_quantity", "match").withColumn("covered_importance", F.round("covered_importance", 4))


def _simple_sql() -> str:
    ratio = div("length(student)", "length(model)")
    a, b = _kind("semantic"), _kind("keyword")
    return f"""SELECT doc_id, round(score, 6) AS score, round(score * 10, 2) AS marks FROM (SELECT doc_id, greatest(0.0, least(1.0, ({a} * semantic + {b} * keyword) / ({a} + {b}) - CASE WHEN {ratio} < 0.5 THEN (0.5 - {ratio}) * 0.1 ELSE 0 END)) AS score
 FROM (SELECT *, [{', '.join(q(k) for k in L.QUESTION_WEIGHTS)}][doc_id % 4 + 1] AS kind, {div('len(list_intersect(s, m))', 'least(len(s), len(m))')} AS semantic, {div('len(list_intersect(s, m))', 'len(m)')} AS keyword FROM (SELECT doc_id, student, model, list_distinct({w('student')}) AS s, list_distinct({w('model')}) AS m FROM ({PAIRS}))))"""


@query(_simple_sql())
def simple_scores(spark, d):
    """The score of meaning and keywords alone, here word overlap by the smaller and by the model's words, without a diagram."""
    x = pairs(spark, d).withColumns({"s": F.array_distinct(T.words(F.col("student"))), "m": F.array_distinct(T.words(F.col("model")))})
    kind = F.get(F.array(*[F.lit(k) for k in L.QUESTION_WEIGHTS]), (F.col("doc_id") % 4).cast("int"))
    x = x.withColumn("score", G.simple_score(kind, S.overlap_smaller(F.col("s"), F.col("m")), S.overlap_first(F.col("m"), F.col("s")), F.lit(0.0), S.length_penalty(F.col("student"), F.col("model"))))
    return x.select("doc_id", r6(F.col("score")).alias("score"), F.round(F.col("score") * 10, 2).alias("marks"))
