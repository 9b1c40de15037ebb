"""Queries of sentence matrices, soft alignment, vector indexes, concept graphs with edges, importance of sentences and scores of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import lexicons as L
from gradus.functions import ocr as O
from gradus.functions import text as T
from gradus.operators import alignment as N
from gradus.operators import concepts as C
from gradus.operators import context as K
from gradus.operators import ranking as R
from gradus.operators import rollups as U
from gradus.operators import set_join as J
from gradus.operators import terms as W
from gradus.operators import vector_index as I
from gradus.sources.scratch import folder, written
from gradus.sources.tables import spread, table

from .answers import answers, over_answers
from .relational import SQL as REL_SQL
from .terms import SQL as TERMS_SQL
from .terms import _terms
from .text import PAIRS, STOP, _role_sql, content, q, r6, sents, strip, w
from .text import SQL as TEXT_SQL
from .text import vocabularies

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


def sentence_sets(side: str) -> Column:
    """The content words of each sentence of one side of answers."""
    return F.transform(T.sentences(F.col(side), 2), T.content_words)


_SETS = f"""s AS (SELECT doc_id, unnest(range(len(ss))) AS student, unnest(list_transform(ss, lambda t: {content('t')})) AS sw FROM (SELECT doc_id, {sents('student', 2)} AS ss FROM ({PAIRS}))),
 m AS (SELECT doc_id, unnest(range(len(ms))) AS model, unnest(list_transform(ms, lambda t: {content('t')})) AS mw FROM (SELECT doc_id, {sents('model', 2)} AS ms FROM ({PAIRS}))),
 x AS (SELECT doc_id, model, student, len(list_intersect(mw, sw)) AS shared, len(list_intersect(mw, sw)) / least(len(mw), len(sw)) AS similarity FROM m JOIN s USING (doc_id) WHERE len(list_intersect(mw, sw)) > 0 AND len(list_intersect(mw, sw)) / least(len(mw), len(sw)) >= {J.SOFT})"""


def matrix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Model sentences of the answers, and their pairs with the student's from 0.40 up."""
    x = answers(spark, d)
    models = x.select("doc_id", F.posexplode(T.sentences(F.col("model"), 2)).alias("model", "s")).select("doc_id", "model")
    sets = x.select("doc_id", sentence_sets("model").alias("models"), sentence_sets("student").alias("students"))
    return models, J.overlap_within(sets, ["doc_id"], "models", "students", "model", "student")


@query(over_answers(f"WITH {_SETS} SELECT doc_id, model, student, shared, round(similarity, 6) AS similarity FROM x"))
def sentence_matrix(spark, d):
    """The sentence matrix of each answer as a table: pairs of a similarity of 0.40 at least."""
    return matrix(spark, d)[1].withColumn("similarity", r6(F.col("similarity")))


@query(over_answers(f"WITH {_SETS} SELECT m.doc_id, m.model, coalesce(list(student ORDER BY similarity DESC, student) FILTER (student IS NOT NULL), []) AS students, coalesce(list(round(similarity, 6) ORDER BY similarity DESC, student) FILTER (student IS NOT NULL), []) AS similarities FROM m LEFT JOIN x USING (doc_id, model) GROUP BY m.doc_id, m.model"))
def soft_alignment(spark, d):
    """For each model sentence all of the student's that match it, the most similar first."""
    models, found = matrix(spark, d)
    found = J.soft_alignment(models, found.withColumn("similarity", r6(F.col("similarity"))), ["doc_id"], "model", "student")
    return found.select("doc_id", "model", F.col("matches.student").alias("students"), F.col("matches.similarity").alias("similarities"))


#: Results of a query, and the share of the exact ones that the probed search is to find.
BEST, RECALL = 5, 0.95


def indexed(spark: SparkSession, d: str) -> tuple[I.Index, DataFrame]:
    """An index over all embeddings, and the stated queries: every 20th id."""
    vectors = table(spark, d, "embeddings")
    return I.Index.build(vectors, folder(spark, "index")), vectors.filter("vec_id % 20 = 0")


@query(TEXT_SQL["cosine_topk"])
def vector_index_exact(spark, d):
    """cosine_topk by the index: lists that can't reach the bar are left out."""
    index, asked = indexed(spark, d)
    return index.search(asked, BEST).withColumn("sim", r6(F.col("sim")))


@query()
def vector_index_probed(spark, d):
    """The same from as few lists as hold 95 in 100 of what some trial queries look for, with each query's recall against the exact result."""
    index, asked = indexed(spark, d)
    found = written(index.search(asked, BEST, index.probe_for(asked, BEST, RECALL)), "found")
    share = I.recall(found, index.search(asked, BEST))
    return found.join(share, "qid").select("qid", "vec_id", r6(F.col("sim")).alias("sim"), r6(F.col("recall")).alias("recall"))


#: Verbs of the clauses that are made of a text's keywords, as the tables' invented prose has none.
JOINING = ["provides", "uses", "contains", "defines", "supports"]


def with_clauses(text):
    """The text and a clause for each two of its first ten keywords: the first, a verb, the second."""
    made = lambda ks: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(F.size(ks) >= i * 2, F.concat_ws(" ", F.get(ks, i * 2 - 2), F.get(F.array(*[F.lit(v) for v in JOINING]), i - 1), F.get(ks, i * 2 - 1))))
    return F.concat(F.coalesce(text, F.lit("")), F.lit(". "), F.array_join(T.let(F.slice(T.keywords(text), 1, 10), made), ". "))


#: Concepts that a graph with statements takes of a text at most, a parameter of these queries and of their SQL.
CONCEPTS = 80


def graphs(spark: SparkSession, d: str) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Concept graphs of the answers' items and of the answers themselves: capitalised words with up to two words after them, ranked, and statements."""
    x = written(answers(spark, d).select("doc_id", with_clauses(F.col("model")).alias("model"), with_clauses(F.col("student")).alias("student")), "clauses")  # what is used several times is written once

    def one(side: str) -> tuple[DataFrame, DataFrame]:
        found = F.regexp_extract_all(side, F.lit("([A-Z][a-z]{3,}(?: [a-z]{4,}){0,2})"), F.lit(1))
        stated = written(C.statements(x, ["doc_id"], F.col(side)), "stated")
        nodes, edges = C.graph(W.ranked_concepts(x, "doc_id", found, F.col(side), CONCEPTS), stated, ["doc_id"])
        return written(nodes, "nodes"), edges

    return one("model"), one("student")


def _clauses_sql(x: str) -> str:
    """The text x with the clauses of its keywords, of which all are in the column x_ks."""
    ks = f"list_filter({x}_ks, lambda t, i: list_position({x}_ks, t) = i)[1:10]"
    return f"(SELECT doc_id, coalesce({x}, '') || '. ' || array_to_string(list_filter(list_transform(range(1, 6), lambda i: CASE WHEN len(k) >= i * 2 THEN concat_ws(' ', k[i * 2 - 1], [{', '.join(map(q, JOINING))}][i], k[i * 2]) END), lambda x: x IS NOT NULL), '. ') AS {x} FROM (SELECT doc_id, {x}, {ks} AS k FROM ks))"


def _keywords_sql(x: str) -> str:
    return f"list_filter(list_transform({w(x)}, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: length(x) >= 3 AND NOT list_contains({STOP}, x))"


def _one_sql(side: str) -> str:
    a = side[0]
    runs = lambda n: f"SELECT doc_id, concept, array_to_string(ws[i:i + {n - 1}], ' ') AS term, 1.5 AS times FROM (SELECT doc_id, concept, string_split(concept, ' ') AS ws, unnest(range(1, len(string_split(concept, ' ')) - {n - 2})) AS i FROM {a}p)"
    verb = lambda v: f"SELECT DISTINCT doc_id, lower({strip('src')}) AS source, '{v}' AS predicate, lower({strip('dst')}) AS target FROM (SELECT doc_id, unnest(regexp_extract_all(s, {q(C.clause(v))}, 1)) AS src, unnest(regexp_extract_all(s, {q(C.clause(v))}, 2)) AS dst FROM {a}s WHERE list_contains(string_split_regex(lower(s), '\\s+'), '{v}'))"
    return f"""{a}p AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all({side}, '[A-Z][a-z]{{3,}}(?: [a-z]{{4,}}){{0,2}}'))) AS concept FROM a), {a}n AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(terms) AS term FROM ({_terms(f'SELECT doc_id, {side} FROM a', side, 3)})) GROUP BY ALL),
 {a}l AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM {a}n GROUP BY 1), {a}h AS (SELECT doc_id, concept, unnest(string_split(concept, ' ')) AS term, 1.0 AS times FROM {a}p UNION ALL {runs(2)} UNION ALL {runs(3)}), {a}z AS (SELECT doc_id, concept, sum(times * n / norm) AS s FROM {a}h JOIN {a}n USING (doc_id, term) JOIN {a}l USING (doc_id) GROUP BY ALL),
 {a}k AS (SELECT doc_id, concept, greatest(0.1, s / max(s) OVER (PARTITION BY doc_id)) AS importance FROM (SELECT doc_id, concept, greatest(coalesce(s, 0), 0.1) AS s FROM {a}p LEFT JOIN {a}z USING (doc_id, concept))),
 {a}c AS (SELECT * FROM {a}k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY importance DESC, concept) <= 80), {a}s AS (SELECT * FROM (SELECT doc_id, unnest(list_transform(string_split_regex({side}, '[.!?]+'), lambda s: {strip('s')})) AS s FROM a) WHERE length(s) >= 10),
 {a}edges AS ({' UNION ALL '.join(verb(v) for v in N.VERBS)}), {a}nodes AS (SELECT doc_id, node, coalesce(max(importance), {C.ORDINARY}) AS importance, sum(own) AS statements, string_split_regex(node, '\\s+') AS ws
 FROM (SELECT doc_id, {strip('concept')} AS node, importance, 0 AS own FROM {a}c UNION ALL SELECT doc_id, source, NULL, 1 FROM {a}edges UNION ALL SELECT doc_id, target, NULL, 0 FROM {a}edges) GROUP BY doc_id, node)"""


_GRAPHS = f"""WITH ks AS MATERIALIZED (SELECT *, {_keywords_sql('model')} AS model_ks, {_keywords_sql('student')} AS student_ks FROM ({PAIRS})), a AS MATERIALIZED (SELECT * FROM {_clauses_sql('model')} JOIN {_clauses_sql('student')} USING (doc_id)), {_one_sql('model')}, {_one_sql('student')},
 met AS (SELECT * FROM (SELECT m.doc_id, m.node, s.node AS other, len(list_intersect(m.ws, s.ws)) / least(len(list_distinct(m.ws)), len(list_distinct(s.ws))) AS score FROM mnodes m JOIN snodes s USING (doc_id)) WHERE score >= {C.PARTIAL}),
 nodes AS (SELECT doc_id, node, importance, statements, coalesce(max(score), 0.0) AS score FROM mnodes LEFT JOIN met USING (doc_id, node) GROUP BY ALL),
 told AS (SELECT DISTINCT e.doc_id, x.node AS source, predicate, y.node AS target FROM sedges e JOIN met x ON x.doc_id = e.doc_id AND x.other = e.source AND x.score >= {C.COVERED} JOIN met y ON y.doc_id = e.doc_id AND y.other = e.target AND y.score >= {C.COVERED}),
 edges AS (SELECT e.doc_id, e.source, e.predicate, e.target, x.importance AS source_importance, y.importance AS target_importance, least(x.score, y.score) AS score, t.source IS NOT NULL AS stated
 FROM medges e JOIN nodes x ON x.doc_id = e.doc_id AND x.node = e.source JOIN nodes y ON y.doc_id = e.doc_id AND y.node = e.target LEFT JOIN told t ON t.doc_id = e.doc_id AND t.source = e.source AND t.predicate = e.predicate AND t.target = e.target)"""


@query(over_answers(f"{_GRAPHS} SELECT doc_id, node, round(importance, 6) AS importance, statements::BIGINT AS statements, round(score, 6) AS score FROM nodes"))
def graph_nodes(spark, d):
    """Nodes of each item's concept graph and how well the answer's nodes match them."""
    nodes, _ = C.covered_graph(*graphs(spark, d), ["doc_id"])
    return nodes.select("doc_id", "node", r6(F.col("importance")).alias("importance"), "statements", r6(F.col("score")).alias("score"))


@query(over_answers(f"{_GRAPHS} SELECT doc_id, source, predicate, target, round(source_importance, 6) AS source_importance, round(target_importance, 6) AS target_importance, round(score, 6) AS score, stated FROM edges"))
def graph_edges(spark, d):
    """Edges of each item's concept graph, with the scores of their ends and whether the answer states them."""
    _, edges = C.covered_graph(*graphs(spark, d), ["doc_id"])
    return edges.select("doc_id", "source", "predicate", "target", *[r6(F.col(c)).alias(c) for c in ("source_importance", "target_importance", "score")], "stated")


@query(over_answers(f"""{_GRAPHS} SELECT doc_id, count(*) AS nodes, count(*) FILTER (score >= {C.COVERED}) AS covered, count(*) FILTER (score >= {C.PARTIAL} AND score < {C.COVERED}) AS partial, count(*) FILTER (score < {C.PARTIAL}) AS missing, round(sum(importance * score), 4) AS covered_importance,
 coalesce(any_value(e), 0) AS edges, coalesce(any_value(ce), 0) AS covered_edges, coalesce(any_value(se), 0) AS stated_edges FROM nodes LEFT JOIN (SELECT doc_id, count(*) AS e, count(*) FILTER (score >= {C.COVERED}) AS ce, count(*) FILTER (stated) AS se FROM edges GROUP BY 1) USING (doc_id) GROUP BY doc_id"""))
def graph_coverage(spark, d):
    """The summary of each item's concept graph against its answer's."""
    return C.summary(*C.covered_graph(*graphs(spark, d), ["doc_id"]), ["doc_id"]).withColumn("covered_importance", F.round("covered_importance", 4))


_DENSITY = """least(2.0, (len(list_filter(ws[2:], lambda x: regexp_matches(x, '^\\P{L}*\\p{Lu}'))) + 0.5 * len(list_filter(ws, lambda x: regexp_matches(x, '\\p{Nd}|\\p{Ll}\\p{Lu}')))) / greatest(len(ws), 1) * 2.0)"""


@query(f"""WITH y AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS s, unnest(range(0, len(ss))) AS place FROM (SELECT doc_id, {sents('text', 2)} AS ss FROM documents)),
 z AS (SELECT *, {_role_sql('s')} AS role, {_DENSITY} AS density, CASE WHEN place = 0 THEN 1.4 WHEN place = n - 1 THEN 1.2 WHEN place <= 2 THEN 1.1 ELSE 1.0 END AS position FROM (SELECT *, list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '') AS ws FROM y))
 SELECT doc_id, place, role, round(salience, 6) AS salience, round(density, 6) AS density, round(greatest(0.3, least(2.0, 0.35 * CASE role {' '.join(f'WHEN {q(k)} THEN {v}' for k, v in L.ROLE_WEIGHTS.items())} ELSE 1.0 END + 0.25 * salience + 0.15 * position + 0.15 * density))::DOUBLE, 8) AS importance
 FROM z JOIN ({TERMS_SQL['sentence_salience'].replace(', 6) AS', ', 15) AS')}) USING (doc_id, place)""")
def sentence_importance(spark, d):
    """Importance of each sentence, with its tf-idf salience and density of names."""
    x = N.important_sentences(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", F.col("text"))
    return x.select("doc_id", "place", "role", r6(F.col("salience")).alias("salience"), r6(F.col("density")).alias("density"), F.round("importance", 8).alias("importance"))


#: The engine's confidence that lines_scored takes, and the length of a full line, as the reference's defaults.
CONFIDENCE, FULL = 0.8, 500


@query(f"""WITH lines AS (SELECT conv_id || ':' || turn || ':' || line AS doc_id, t AS text FROM (SELECT conv_id, turn, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM (SELECT conv_id, turn, list_transform(string_split({strip('text')}, chr(10)), lambda l: {strip('l')}) AS ls FROM conversations)))
 SELECT doc_id AS line_id, text = '' AS empty, round(bigram, 6) AS bigram, round(certainty, 6) AS certainty, round(valid, 6) AS valid, round(repeated, 6) AS repeated, round(length(text) / {FULL}, 6)::DOUBLE AS length, round(CASE WHEN text = '' THEN 0.0 ELSE greatest(0.0, least(1.0, 0.30 * {CONFIDENCE} + 0.25 * valid + 0.20 * bigram + 0.10 * certainty + 0.10 * least(1.0, length(text) / {FULL}) - 0.05 * repeated)) END::DOUBLE, 5) AS quality
 FROM lines JOIN ({TEXT_SQL['ocr_quality'].replace('documents', 'lines').replace(', 6) AS', ', 15) AS')}) USING (doc_id)""")
def line_scores(spark, d):
    """The quality scores of each line of a scanned text, as conversations have lines."""
    bare = F.transform(F.split(T.strip(F.coalesce("text", F.lit(""))), "\n"), T.strip)
    x = spread(table(spark, d, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", F.posexplode(bare).alias("line", "text"))
    t = F.col("text")
    parts = {"bigram": O.bigram_score(t), "certainty": O.char_certainty(t), "valid": O.valid_ratio(t), "repeated": O.repetition(t), "length": F.char_length(t) / FULL, "quality": O.quality(t, F.lit(CONFIDENCE), FULL)}
    return x.select(F.concat_ws(":", "conv_id", "turn", F.col("line") + 1).alias("line_id"), (t == "").alias("empty"), *[F.round(v, 5 if k == "quality" else 6).alias(k) for k, v in parts.items()])


#: Frequent words whose pairs are counted besides, as one of them is likely the most frequent.
OFTEN = 500


@query()
def context_corrections(spark, d):
    """Unknown words of the items, corrected by the documents' words and word pairs together."""
    _, known = vocabularies(spark, d)
    docs = spread(table(spark, d, "documents").select("text"))
    often = known.orderBy(F.desc("n"), "word").limit(OFTEN).select("word")
    return K.corrected(table(spark, d, "benchmark").select("item_id", "text"), known, lambda words: K.pairs_among(docs, F.col("text"), words.unionByName(often)), ["item_id"])


@query(REL_SQL["kendall_order"])
def order_agreement(spark, d):
    """kendall_order by inversions, for keys of any number of rows."""
    found = R.order_scores(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")
    return found.select("l_orderkey", r6(F.col("score")).alias("order_score"))


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END * value), 4) AS total, count(DISTINCT user_id) AS users FROM events WHERE event_id % 11 <> 0 GROUP BY ALL""")
def rollup_after_changes(spark, d):
    """Daily activity from four batches of changes: events come in two, then every seventh is corrected to twice its value, and every eleventh goes."""
    e = table(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), "value", "user_id")
    store = U.Rollups(spark, folder(spark, "rollups"), ["event_type", "day"])
    seventh, eleventh = F.col("event_id") % 7 == 0, F.col("event_id") % 11 == 0
    doubled = e.filter(seventh).withColumn("value", F.col("value") * 2)
    comes, goes = F.lit(1).alias("times"), F.lit(-1).alias("times")
    gone = e.filter(eleventh & ~seventh).unionByName(doubled.filter(eleventh))
    batches = [e.filter(F.col("event_id") % 2 == 0).select("*", comes), e.filter(F.col("event_id") % 2 != 0).select("*", comes), e.filter(seventh).select("*", goes).unionByName(doubled.select("*", comes)), gone.select("*", goes)]
    for number, batch in enumerate(batches, 1):
        store.apply(number, batch, "value", "user_id")
    store.compact(2)
    found = U.dashboard(store.read(), store.keys)
    return found.select("event_type", "day", "n", F.round("total", 4).alias("total"), F.col("members").alias("users"))
