"""Registered queries of the core and the SQL they are checked against.

Questions are the chunks whose vector id is divisible by 50: the chunk's title (with a
quantity it speaks of, and for every other one its file name) is the question's text, the
chunk's vector the question's vector. Some questions compare, some name a subsystem (the
title's code and the word before it). Floats are rounded where two engines may sum in
another order.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, bm25, chunking, corpus, dense, manifest, models, procedure, retrieval, units
from ..runtime import REPEATED, materialize, once, shared_dir, table, table_state
from ..sources import files

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- inputs ---------------------------------------------------------------------
def chunks(spark, d):
    return table(spark, d, "store").dropDuplicates(["chunk_id"])


def questions(spark, d):
    s = table(spark, d, "store").select("chunk_id", "content", "filename", "folder")
    i = table(spark, d, "ingest").where("vec_id % 50 = 0").select("vec_id", "chunk_id", "embeddings")
    ids = i.select("chunk_id").distinct()
    if ids.limit(REPEATED + 1).count() <= REPEATED:
        s = s.join(F.broadcast(ids), "chunk_id", "left_semi")  # at most REPEATED ids: other chunks aren't shuffled
    s = s.dropDuplicates(["chunk_id"])
    said = F.regexp_extract("content", r"^\[([^\]]*)\]", 1)
    about = F.regexp_extract(F.lower("content"), "[a-z]+ (pressure|temperature|mass|torque|flow)", 0)
    name = F.when(F.col("vec_id") % 100 == 0, F.concat(F.lit(" "), "filename")).otherwise("")
    more = F.when(F.col("vec_id") % 250 == 0, " which is highest").when(F.col("vec_id") % 150 == 50, F.concat(F.lit(" "), F.regexp_replace(said, r"^(?:.* )?([A-Z][a-z]+) ([A-Z]+-\d+)$", "$2 $1"))).otherwise("")
    return i.join(s, "chunk_id").select(F.col("vec_id").alias("q_id"), F.trim(F.concat(said, F.lit(" "), about, name, more)).alias("text"), "folder", F.col("embeddings").alias("vec"), F.col("chunk_id").alias("self_id"))


def questions_in_folders(spark, d):
    """The questions, half of them with their own folder as filter."""
    return questions(spark, d).withColumn("folder_filter", F.when(F.col("q_id") % 100 == 50, F.col("folder")))


def vectors(spark, d):
    return table(spark, d, "ingest").select("chunk_id", F.col("embeddings").alias("vec"))


def vectors_in_folders(spark, d):
    return vectors(spark, d).join(chunks(spark, d).select("chunk_id", "folder"), "chunk_id", "left")


def overlap(q, t):
    """A stand-in for a reranking model: how many of the question's terms the text has."""
    return F.size(F.array_intersect(T.tokens(q), T.tokens(t))).cast("double")


def _index(spark, d, c=None):
    """The unstemmed index, stored in the shared folder under the state of the table's files: built where that state has none yet."""
    return bm25.load_or_build(spark, f"{shared_dir(spark)}/lectern/index-{table_state(spark, d, 'store')}", lambda: once(table(spark, d, "store"), "chunk_id") if c is None else c, use_stem=False, unique=True)


def _stages(spark, d, until="prompts", asked=questions, vectors=vectors):
    c = materialize(once(table(spark, d, "store"), "chunk_id"), "chunks")
    return retrieval.stages(materialize(asked(spark, d), "asked"), c, _index(spark, d, c), vectors(spark, d), reranker=overlap, originals=table(spark, d, "seen"), until=until)


WORD = r"'[0-9]+\.[0-9]+|[\p{L}\p{N}\p{M}_]+'"
_VALUE = T.VALUE_RE.replace("'", "''")
_COMPARES = T.COMPARISON_RE.replace("'", "''")
CHAIN = rf"""
WITH s AS (SELECT DISTINCT * FROM store),
q AS (SELECT i.vec_id AS q_id, trim(regexp_extract(s.content, '^\[([^\]]*)\]', 1) || ' ' || regexp_extract(lower(s.content), '[a-z]+ (pressure|temperature|mass|torque|flow)', 0) || CASE WHEN i.vec_id % 100 = 0 THEN ' ' || s.filename ELSE '' END || CASE WHEN i.vec_id % 250 = 0 THEN ' which is highest' WHEN i.vec_id % 150 = 50 THEN ' ' || regexp_replace(regexp_extract(s.content, '^\[([^\]]*)\]', 1), '^(?:.* )?([A-Z][a-z]+) ([A-Z]+-\d+)$', '\2 \1') ELSE '' END) AS text, s.folder AS folder, NULL::VARCHAR AS ff, i.chunk_id AS self_id, i.embeddings AS vec
      FROM ingest i JOIN s ON i.chunk_id = s.chunk_id WHERE i.vec_id % 50 = 0),
u AS (SELECT vec_id, chunk_id, embeddings::DOUBLE[] AS v, list_dot_product(embeddings::DOUBLE[], embeddings::DOUBLE[]) AS ss FROM ingest
      WHERE embeddings IS NOT NULL AND len(embeddings) = 64 AND list_bool_and([isfinite(x) for x in embeddings]) AND list_dot_product(embeddings::DOUBLE[], embeddings::DOUBLE[]) > 0),
sim AS (SELECT a.vec_id AS q_id, u.chunk_id, round(list_dot_product(a.v, u.v) / sqrt(a.ss * u.ss), 9) AS sim FROM u a JOIN q ON q.q_id = a.vec_id JOIN u ON u.chunk_id <> a.chunk_id LEFT JOIN s ON s.chunk_id = u.chunk_id WHERE q.ff IS NULL OR s.folder = q.ff),
sem AS (SELECT q_id, chunk_id, 1 - sim AS distance, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, chunk_id) AS sem_rank FROM sim QUALIFY sem_rank <= 15),
fn AS (SELECT DISTINCT filename, lower(filename) AS f, regexp_replace(lower(filename), '\.[^.]*$', '') AS st FROM s WHERE filename <> ''),
nm0 AS (SELECT DISTINCT q_id, filename FROM q, fn WHERE contains(lower(text), f) OR (length(st) >= 6 AND regexp_matches(' ' || lower(text) || ' ', '[^\p{{L}}\p{{N}}_]' || regexp_escape(st) || '[^\p{{L}}\p{{N}}_]'))),
oq AS (SELECT q_id FROM sem GROUP BY 1 HAVING bool_or(distance <= 1.3) UNION SELECT q_id FROM nm0),
qq AS (SELECT q_id, text, ff, regexp_matches(text, '{_VALUE}') AS for_value FROM q WHERE q_id IN (FROM oq)),
nm AS (SELECT q_id, filename, greatest(2, 8 // count(*) OVER (PARTITION BY q_id)) AS slots, least(8, greatest(4, 8 // count(*) OVER (PARTITION BY q_id))) AS dlimit FROM nm0 WHERE q_id IN (FROM oq)),
tok AS (SELECT chunk_id, folder, unnest(regexp_extract_all(lower('[' || coalesce(filename, '') || '] ' || coalesce(content, '')), {WORD})) AS term FROM s),
post AS (SELECT term, chunk_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT chunk_id, any_value(folder) AS folder, count(*) AS dl FROM tok GROUP BY 1),
stat AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
df0 AS (SELECT term, count(*) AS n, ln((SELECT n_docs FROM stat) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY 1),
tm AS (SELECT term, n, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df0) ELSE raw END AS idf FROM df0),
qt AS (SELECT q_id, term, count(*) AS qtf FROM (SELECT q_id, unnest(regexp_extract_all(lower(text), {WORD})) AS term FROM q) GROUP BY ALL),
sc AS (SELECT q_id, chunk_id, any_value(dl.folder) AS folder, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM qt JOIN tm USING (term) JOIN post USING (term) JOIN dl USING (chunk_id), stat GROUP BY 1, 2),
lex AS (SELECT sc.q_id, chunk_id, bm25, row_number() OVER (PARTITION BY sc.q_id ORDER BY round(bm25, 9) DESC, chunk_id) AS bm25_rank FROM sc JOIN qq ON qq.q_id = sc.q_id WHERE bm25 > 0 AND (ff IS NULL OR sc.folder = ff) QUALIFY bm25_rank <= CASE WHEN for_value THEN 30 ELSE 15 END),
dlist AS (SELECT q_id, chunk_id, row_number() OVER (PARTITION BY q_id ORDER BY sem_rank NULLS LAST, bm25_rank) AS rank FROM (
  SELECT q_id, chunk_id, sem_rank, NULL AS bm25_rank FROM sem WHERE q_id IN (FROM oq) UNION ALL SELECT q_id, chunk_id, NULL, bm25_rank FROM lex WHERE (q_id, chunk_id) NOT IN (SELECT (q_id, chunk_id) FROM sem))),
rrf AS (SELECT q_id, chunk_id, sum(w / (60 + rank)) AS score FROM (SELECT q_id, chunk_id, rank, 1.0::DOUBLE AS w FROM dlist UNION ALL SELECT lex.q_id, chunk_id, bm25_rank, CASE WHEN for_value THEN 2.0 ELSE 1.0 END::DOUBLE FROM lex JOIN qq ON qq.q_id = lex.q_id) GROUP BY 1, 2),
nch AS (SELECT nm.q_id, nm.filename, slots, s.chunk_id, page, chunk_index, row_number() OVER (PARTITION BY nm.q_id, nm.filename ORDER BY round(coalesce(bm25, 0), 9) DESC, s.chunk_id) AS r FROM nm JOIN qq ON qq.q_id = nm.q_id JOIN s ON s.filename = nm.filename AND (ff IS NULL OR s.folder = ff) LEFT JOIN sc ON sc.q_id = nm.q_id AND sc.chunk_id = s.chunk_id),
sub AS (SELECT DISTINCT q_id, ff, unnest(regexp_extract_all(text, '{T.SUBSYSTEM}', 1)) AS name FROM qq),
subt AS (SELECT q_id, name, term, count(*) AS qtf FROM (SELECT q_id, name, unnest(regexp_extract_all(lower(name), {WORD})) AS term FROM sub) GROUP BY ALL),
subsc AS (SELECT q_id, name, chunk_id, any_value(dl.folder) AS folder, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM subt JOIN tm USING (term) JOIN post USING (term) JOIN dl USING (chunk_id), stat GROUP BY 1, 2, 3),
subtop AS (SELECT x.q_id, x.name, chunk_id, ff FROM subsc x JOIN sub ON sub.q_id = x.q_id AND sub.name = x.name WHERE bm25 > 0 AND (ff IS NULL OR folder = ff) QUALIFY row_number() OVER (PARTITION BY x.q_id, x.name ORDER BY round(bm25, 9) DESC, chunk_id) = 1),
cmpt AS (SELECT q_id, ff, term, count(*) AS qtf FROM (SELECT q_id, ff, unnest(regexp_extract_all(lower('domain performance digest top performer ' || text), {WORD})) AS term FROM qq WHERE regexp_matches(text, '{_COMPARES}')) GROUP BY ALL),
cmpsc AS (SELECT q_id, any_value(ff) AS ff, chunk_id, any_value(dl.folder) AS folder, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM cmpt JOIN tm USING (term) JOIN post USING (term) JOIN dl USING (chunk_id), stat GROUP BY q_id, chunk_id),
cmp AS (SELECT q_id, chunk_id, row_number() OVER (PARTITION BY q_id ORDER BY round(bm25, 9) DESC, chunk_id) AS r FROM cmpsc WHERE bm25 > 0 AND (ff IS NULL OR folder = ff) QUALIFY r <= 15),
fl AS (SELECT q_id, chunk_id, 2.0::DOUBLE / (60 + r) AS floor, 'named' AS origin FROM nch WHERE r <= slots UNION ALL SELECT q_id, chunk_id, 3.0::DOUBLE / 61, 'summary_of_named' FROM nch WHERE page = 1 AND chunk_index = -1
  UNION ALL SELECT DISTINCT t.q_id, z.chunk_id, 2.0::DOUBLE / 61, 'subsystem' FROM subtop t JOIN s ON s.chunk_id = t.chunk_id JOIN s z ON z.doc_id = s.doc_id AND z.page = s.page AND z.chunk_index = -1 WHERE ff IS NULL OR z.folder = ff
  UNION ALL SELECT q_id, chunk_id, 3.0::DOUBLE / (60 + r), 'comparison' FROM cmp),
raised AS (SELECT coalesce(a.q_id, b.q_id) AS q_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, greatest(coalesce(score, 0), coalesce(floor, 0)) AS score, coalesce(origin, 'ranked') AS origin FROM rrf a FULL JOIN (SELECT q_id, chunk_id, max(floor) AS floor, min(origin) AS origin FROM fl GROUP BY 1, 2) b ON a.q_id = b.q_id AND a.chunk_id = b.chunk_id),
boosted AS (SELECT r.q_id, r.chunk_id, score * CASE WHEN s.page = 1 AND s.chunk_index = -1 THEN 3.0 ELSE 1.0 END * CASE WHEN for_value AND coalesce(table_id, '') <> '' THEN 1.5 ELSE 1.0 END AS score, origin FROM raised r JOIN s ON s.chunk_id = r.chunk_id JOIN qq ON qq.q_id = r.q_id),
pool AS (SELECT b.*, s.content, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 12) DESC, b.chunk_id) AS r FROM boosted b JOIN s ON s.chunk_id = b.chunk_id),
renew AS (SELECT p.q_id, p.chunk_id, row_number() OVER (PARTITION BY p.q_id ORDER BY len(list_intersect(regexp_extract_all(lower(qq.text), {WORD}), regexp_extract_all(lower(coalesce(content, '')), {WORD}))) DESC, r) AS new FROM pool p JOIN qq ON qq.q_id = p.q_id WHERE r <= 20),
rsize AS (SELECT q_id, count(*) AS size FROM renew GROUP BY 1),
reranked AS (SELECT p.q_id, p.chunk_id, CASE WHEN new IS NOT NULL THEN 1.0::DOUBLE / (60 + new) WHEN origin IN ('named', 'summary_of_named', 'subsystem', 'comparison') THEN score ELSE least(score, 0.5::DOUBLE / (60 + size + 1)) END AS score, origin FROM pool p LEFT JOIN renew n ON n.q_id = p.q_id AND n.chunk_id = p.chunk_id JOIN rsize ON rsize.q_id = p.q_id),
infile AS (SELECT r.q_id, r.chunk_id, r.score, s.filename, coalesce(dlimit, 2) AS lim, row_number() OVER (PARTITION BY r.q_id, s.filename ORDER BY round(r.score, 12) DESC, r.chunk_id) AS n FROM reranked r JOIN s ON s.chunk_id = r.chunk_id LEFT JOIN nm ON nm.q_id = r.q_id AND nm.filename = s.filename),
top AS (SELECT q_id, chunk_id, score, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 12) DESC, chunk_id) AS pos FROM infile WHERE n <= lim QUALIFY pos <= 8),
tdoc AS (SELECT q_id, doc_id, bool_or(page = 1 AND chunk_index = -1) AS has, FROM top JOIN s USING (chunk_id) GROUP BY 1, 2),
ident AS (SELECT q_id, chunk_id, pos, 'top' AS origin FROM top UNION ALL SELECT t.q_id, s.chunk_id, (SELECT max(pos) FROM top x WHERE x.q_id = t.q_id) + row_number() OVER (PARTITION BY t.q_id ORDER BY s.chunk_id), 'identity' FROM tdoc t JOIN s ON s.doc_id = t.doc_id AND s.page = 1 AND s.chunk_index = -1 WHERE NOT has),
tids AS (SELECT DISTINCT q_id, table_id FROM ident JOIN s USING (chunk_id) WHERE coalesce(table_id, '') <> ''),
tch AS (SELECT q_id, s.chunk_id, row_number() OVER (PARTITION BY q_id ORDER BY page, chunk_index, s.chunk_id) AS r FROM (SELECT q_id, table_id FROM tids WHERE table_id IN (SELECT table_id FROM s GROUP BY 1 HAVING count(*) <= 24)) t JOIN s ON s.table_id = t.table_id QUALIFY r <= 32),
ctx AS (SELECT q_id, chunk_id, row_number() OVER (PARTITION BY q_id ORDER BY g, p) AS pos, origin FROM (SELECT q_id, chunk_id, 0 AS g, r AS p, 'table' AS origin FROM tch WHERE (q_id, chunk_id) NOT IN (SELECT (q_id, chunk_id) FROM ident) UNION ALL SELECT q_id, chunk_id, 1, pos, origin FROM ident)),
hit AS (SELECT c.q_id, c.pos, c.chunk_id, a.doc_id, a.filename, a.page, a.chunk_type, a.chunk_index, n.chunk_id AS n_id, n.chunk_index AS n_index, coalesce(n.content, '') AS n_text, min(c.pos) OVER (PARTITION BY c.q_id, n.chunk_id) = c.pos AS fresh FROM ctx c JOIN s a ON a.chunk_id = c.chunk_id
  JOIN s n ON n.doc_id = a.doc_id AND n.page = a.page AND (n.chunk_id = a.chunk_id OR (a.chunk_index >= 0 AND n.chunk_index BETWEEN greatest(a.chunk_index - 2, 0) AND a.chunk_index + 2))),
blk AS (SELECT q_id, pos, chunk_id, doc_id, filename, page, any_value(chunk_type) AS chunk_type, any_value(chunk_index) AS chunk_index, count(*) AS neighbours, '[' || filename || ', page ' || page || chr(93) || chr(10) || string_agg(n_text, chr(10) ORDER BY n_index) AS block FROM hit GROUP BY q_id, pos, chunk_id, doc_id, filename, page HAVING bool_or(fresh)),
cit AS (SELECT q_id, doc_id, any_value(filename) AS filename, list_sort(list(DISTINCT page)) AS pages, min(page) AS page, count(DISTINCT CASE WHEN chunk_type = 'image' THEN page * 1000 + (-100 - chunk_index) END) AS figures, min(pos) AS first FROM blk GROUP BY 1, 2)
"""


# -- keyword and dense search ------------------------------------------------------
@query(CHAIN + "SELECT term, n, round(idf, 6) AS idf FROM tm")
def bm25_terms(spark, d):
    """Document frequencies and inverse frequencies of all terms."""
    return _index(spark, d).terms().select("term", "n", F.round("idf", 6).alias("idf"))


@query(CHAIN + "SELECT chunk_id, dl FROM dl")
def bm25_lengths(spark, d):
    """Tokens of each indexed chunk."""
    return _index(spark, d).doclen.select("chunk_id", F.col("dl").cast("bigint").alias("dl"))


@query(CHAIN + "SELECT q_id, chunk_id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY q_id ORDER BY round(bm25, 9) DESC, chunk_id) AS bm25_rank FROM sc WHERE bm25 > 0 QUALIFY bm25_rank <= 15")
def bm25_topk(spark, d):
    """The best 15 chunks by keywords for every question."""
    return bm25.search(_index(spark, d), questions(spark, d).select("q_id", "text")).select("q_id", "chunk_id", F.round("bm25", 6).alias("bm25"), "bm25_rank")


@query(CHAIN + "SELECT sc.q_id, chunk_id, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY sc.q_id ORDER BY round(bm25, 9) DESC, chunk_id) AS bm25_rank FROM sc JOIN q ON q.q_id = sc.q_id WHERE bm25 > 0 AND (q.folder IS NULL OR sc.folder = q.folder) QUALIFY bm25_rank <= 15")
def bm25_in_folder(spark, d):
    """The same within the question's folder."""
    q = questions(spark, d).select("q_id", "text", F.col("folder").alias("folder_filter"))
    return bm25.search(_index(spark, d), q).select("q_id", "chunk_id", F.round("bm25", 6).alias("bm25"), "bm25_rank")


@query(CHAIN + "SELECT chunk_id, count(*) AS terms, sum(tf)::BIGINT AS tf FROM post WHERE NOT (chunk_id IN (SELECT chunk_id FROM s WHERE doc_id IN (SELECT doc_id FROM incoming))) GROUP BY 1")
def bm25_after_removal(spark, d):
    """The index once the documents of incoming are taken out."""
    gone = corpus.by_ids(chunks(spark, d), chunks(spark, d).join(table(spark, d, "incoming").select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")).select("chunk_id")
    return bm25.remove(_index(spark, d), gone).postings.groupBy("chunk_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tf"))


@query(CHAIN + "SELECT q_id, chunk_id, round(distance, 6) AS distance, sem_rank FROM sem")
def dense_topk(spark, d):
    """The 15 nearest chunks of every question, exactly."""
    return dense.top_k(questions(spark, d), vectors(spark, d)).select("q_id", "chunk_id", F.round("distance", 6).alias("distance"), "sem_rank")


@query(CHAIN + "SELECT q_id, count(*) AS hits, count(*) FILTER (distance <= 0.5) AS near FROM sem GROUP BY 1 HAVING bool_or(distance <= 0.5)")
def semantic_gate(spark, d):
    """Questions that some chunk is nearer to than 0.5, and how many."""
    sem = dense.top_k(questions(spark, d), vectors(spark, d))
    ok = retrieval.open_questions(sem, threshold=0.5)
    return sem.join(ok, "q_id", "left_semi").groupBy("q_id").agg(F.count("*").alias("hits"), F.count_if(F.col("distance") <= 0.5).alias("near"))


@query(CHAIN + "SELECT q_id, chunk_id, round(min(distance), 6) AS distance FROM (SELECT q_id, chunk_id, distance FROM sem UNION ALL SELECT q_id, chunk_id, distance + 0.25 FROM sem WHERE sem_rank > 5) GROUP BY 1, 2")
def merged_hits(spark, d):
    """Hits of two variants, the smallest distance of each chunk."""
    sem = dense.top_k(questions(spark, d), vectors(spark, d))
    second = sem.where("sem_rank > 5").withColumn("distance", F.col("distance") + 0.25)
    return retrieval.merge_hits(sem, second).select("q_id", "chunk_id", F.round("distance", 6).alias("distance"))


# -- the pipeline, stage by stage -----------------------------------------------------
@query(CHAIN + "SELECT q_id, filename FROM nm0")
def named_documents(spark, d):
    """Files that questions name."""
    return retrieval.named_documents(questions(spark, d), chunks(spark, d))


@query(CHAIN + "SELECT q_id, chunk_id, round(score, 9) AS score FROM rrf")
def rrf_hybrid(spark, d):
    """Dense and keyword lists fused by reciprocal ranks."""
    return _stages(spark, d, "rrf")["rrf"].select("q_id", "chunk_id", F.round("score", 9).alias("score"))


@query(CHAIN + "SELECT q_id, chunk_id, round(floor, 9) AS floor, origin FROM fl")
def named_injection(spark, d):
    """Least scores of the chunks of named documents, named subsystems and comparisons."""
    return _stages(spark, d, "floors")["floors"].select("q_id", "chunk_id", F.round("floor", 9).alias("floor"), "origin")


@query(CHAIN + "SELECT q_id, chunk_id, round(score, 9) AS score, origin FROM boosted")
def boosted_scores(spark, d):
    """Scores after floors and boosts."""
    return _stages(spark, d, "boosted")["boosted"].select("q_id", "chunk_id", F.round("score", 9).alias("score"), "origin")


@query(CHAIN + "SELECT q_id, chunk_id, round(score, 9) AS score FROM reranked")
def reranked_scores(spark, d):
    """Scores after the pool of 20 is reranked and the others capped."""
    return _stages(spark, d, "boosted")["reranked"].select("q_id", "chunk_id", F.round("score", 9).alias("score"))


@query(CHAIN + "SELECT q_id, chunk_id, pos FROM top")
def diverse_top(spark, d):
    """The best 8, few of a file (V3, K4)."""
    return _stages(spark, d, "top")["top"].select("q_id", "chunk_id", "pos")


@query(CHAIN + "SELECT q_id, chunk_id, pos, origin FROM ctx")
def context_chunks(spark, d):
    """Chosen chunks with summaries and whole tables."""
    return _stages(spark, d, "context")["context"]


@query(CHAIN + "SELECT q_id, pos, chunk_id, neighbours, md5(block) AS block_md5 FROM blk")
def context_blocks(spark, d):
    """Context blocks with neighbours, none twice (J11, V9): flagship."""
    return _stages(spark, d)["blocks"].select("q_id", "pos", "chunk_id", F.size("neighbours").cast("bigint").alias("neighbours"), F.md5("block").alias("block_md5"))


IN_FOLDERS = CHAIN.replace("NULL::VARCHAR AS ff", "CASE WHEN i.vec_id % 100 = 50 THEN s.folder END AS ff")


@query(IN_FOLDERS + "SELECT q_id, chunk_id, round(distance, 6) AS distance, sem_rank FROM sem")
def dense_in_folder(spark, d):
    """The nearest chunks, for half of the questions within their folder."""
    return dense.top_k(questions_in_folders(spark, d), vectors_in_folders(spark, d)).select("q_id", "chunk_id", F.round("distance", 6).alias("distance"), "sem_rank")


@query(IN_FOLDERS + "SELECT q_id, pos, chunk_id, origin FROM ctx")
def folder_context(spark, d):
    """Chosen chunks where half of the questions are kept to their folder: no list leads out of it (F1, F2)."""
    return _stages(spark, d, "context", questions_in_folders, vectors_in_folders)["context"].select("q_id", "pos", "chunk_id", "origin")


@query("""WITH s AS (SELECT DISTINCT * FROM store), h AS (SELECT doc_id, arg_min({'f': filename, 'o': folder}, (page, chunk_index, chunk_id)) AS h FROM s WHERE chunk_index IN (-1, 0) GROUP BY 1),
l AS (SELECT doc_id, h.f AS filename, coalesce(h.o, 'General') AS folder, row_number() OVER (PARTITION BY coalesce(h.o, 'General') ORDER BY lower(h.f), doc_id) AS r, row_number() OVER (ORDER BY lower(h.f), doc_id) AS ra FROM h),
c AS (SELECT doc_id, chunk_id, filename, page, content, chunk_index >= 0 AS body, row_number() OVER (PARTITION BY doc_id, chunk_index >= 0 ORDER BY chunk_index, chunk_id) AS n, bool_or(chunk_index >= 0) OVER (PARTITION BY doc_id) AS any_body FROM s WHERE page = 1 AND coalesce(chunk_type, '') <> 'image' AND trim(coalesce(content, '')) <> ''),
f AS (SELECT * FROM c WHERE CASE WHEN any_body THEN body AND n <= 3 ELSE n <= 2 END),
q AS (SELECT DISTINCT folder AS want FROM documents),
w AS (SELECT want, l.doc_id, CASE WHEN want IS NULL THEN ra ELSE r END AS r FROM q JOIN l ON CASE WHEN want IS NULL THEN ra <= 15 ELSE l.folder = want AND r <= 15 END)
SELECT coalesce(want, '') AS folder, row_number() OVER (PARTITION BY want ORDER BY r, n) AS pos, chunk_id, md5('[' || filename || ', page ' || page || chr(93) || chr(10) || content) AS block_md5 FROM w JOIN f ON f.doc_id = w.doc_id""")
def catalog_context(spark, d):
    """What a question for the list of all documents gets, for each folder that documents use and for none (F19, K6): through the pipeline's own route."""
    f = table(spark, d, "documents").select(F.col("folder").alias("folder_filter")).distinct()
    q = f.select(F.xxhash64(F.coalesce("folder_filter", F.lit(""))).alias("q_id"), F.lit("Show a table of all documents with their revisions").alias("text"), "folder_filter")
    q = materialize(q.withColumn("vec", F.lit(None).cast("array<float>")).withColumn("self_id", F.lit("")), "asked")
    c = materialize(once(table(spark, d, "store"), "chunk_id"), "chunks")
    s = retrieval.stages(q, c, lambda: _index(spark, d, c), vectors_in_folders(spark, d))["blocks"]
    return s.join(q, "q_id").select(F.coalesce("folder_filter", F.lit("")).alias("folder"), "pos", "chunk_id", F.md5("block").alias("block_md5"))


@query(CHAIN + "SELECT q_id, c.doc_id, filename, array_to_string(pages, ',') AS pages, page, figures, c.doc_id IN (SELECT doc_id FROM seen WHERE doc_id IS NOT NULL) AS has_original, row_number() OVER (PARTITION BY q_id ORDER BY first) AS cited FROM cit c")
def citations(spark, d):
    """Sources in the order they were first cited."""
    c = _stages(spark, d)["citations"]
    return c.select("q_id", "doc_id", "filename", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "page", F.size("figures").cast("bigint").alias("figures"), "has_original", "cited")


@query(CHAIN + "SELECT b.q_id, md5('Answer from the excerpts only. If they don''t hold the answer, reply: That information is not in the ingested documents.' || chr(10) || 'Files: ' || f.files || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) || chr(10) || chr(10) || 'Question: ' || any_value(qq.text)) AS prompt_md5 FROM blk b JOIN qq ON qq.q_id = b.q_id JOIN (SELECT q_id, string_agg(filename, ', ' ORDER BY p) AS files FROM (SELECT q_id, filename, min(pos) AS p FROM blk GROUP BY 1, 2) GROUP BY 1) f ON f.q_id = b.q_id GROUP BY b.q_id, f.files")
def prompts(spark, d):
    """The prompt of every question (M9)."""
    return _stages(spark, d)["prompts"].select("q_id", F.md5("prompt").alias("prompt_md5"))


# -- corpus: listings and changes ------------------------------------------------------
_S = "WITH s AS (SELECT DISTINCT * FROM store) "


@query(_S + "SELECT count(*) AS chunks FROM s")
def chunk_count(spark, d):
    """All chunks (A1)."""
    return corpus.count(chunks(spark, d))


@query(_S + """, h AS (SELECT doc_id, arg_min({'f': filename, 'o': folder, 'n': doc_number, 'r': revision}, (page, chunk_index, chunk_id)) AS h FROM s WHERE chunk_index IN (-1, 0) GROUP BY 1)
SELECT h.doc_id, h.h.f AS filename, coalesce(h.h.o, 'General') AS folder, coalesce(h.h.n, '—') AS doc_number, coalesce(h.h.r, '—') AS revision, c.chunks, h.doc_id IN (SELECT doc_id FROM seen WHERE doc_id IS NOT NULL) AS has_original
FROM h JOIN (SELECT doc_id, count(*) AS chunks FROM s GROUP BY 1) c ON c.doc_id = h.doc_id""")
def document_listing(spark, d):
    """Documents with head row, number of chunks and whether the original is known."""
    return corpus.documents(chunks(spark, d), table(spark, d, "seen"))


@query(_S + "SELECT DISTINCT folder FROM s WHERE folder <> ''")
def folder_listing(spark, d):
    """Distinct folders (A3)."""
    return corpus.folders(chunks(spark, d))


@query(_S + """, h AS (SELECT doc_id, arg_min({'f': filename, 'n': doc_number, 'r': revision}, (page, chunk_index, chunk_id)) AS h FROM s WHERE chunk_index IN (-1, 0) GROUP BY 1)
SELECT doc_id, lower(h.f) AS sort_key, '| ' || h.f || ' | ' || coalesce(h.n, '—') || ' | ' || coalesce(h.r, '—') || ' |' AS row FROM h""")
def catalog_rows(spark, d):
    """The catalogue as markdown rows."""
    return corpus.catalog(corpus.documents(chunks(spark, d)))


@query(_S + """, c AS (SELECT doc_id, chunk_id, chunk_index, chunk_index >= 0 AS body, row_number() OVER (PARTITION BY doc_id, chunk_index >= 0 ORDER BY chunk_index, chunk_id) AS r, bool_or(chunk_index >= 0) OVER (PARTITION BY doc_id) AS any_body FROM s WHERE page = 1 AND coalesce(chunk_type, '') <> 'image' AND trim(coalesce(content, '')) <> '')
SELECT doc_id, chunk_id, r FROM c WHERE CASE WHEN any_body THEN body AND r <= 3 ELSE r <= 2 END""")
def front_matter(spark, d):
    """The first text chunks of page 1 of each document."""
    return corpus.front_matter(chunks(spark, d))


@query(_S + "SELECT chunk_id, doc_id, page, chunk_index FROM s WHERE chunk_index >= 0 AND chunk_type IS DISTINCT FROM 'image' AND folder IN (SELECT folder FROM documents WHERE folder IS NOT NULL)")
def text_chunks_in_folders(spark, d):
    """Text chunks of the folders that documents use."""
    f = table(spark, d, "documents").select("folder").where("folder is not null").distinct()
    keep = retrieval.all_of(F.col("chunk_index") >= 0, retrieval.ne("chunk_type", "image"))
    return chunks(spark, d).where(keep).join(f, "folder", "left_semi").select("chunk_id", "doc_id", "page", "chunk_index")


@query(_S + "SELECT chunk_id, length(content) AS chars FROM s WHERE chunk_id IN (SELECT chunk_id FROM ingest WHERE caption IS NOT NULL)")
def chunks_by_ids(spark, d):
    """Point lookup of the captioned chunks."""
    ids = table(spark, d, "ingest").where("caption is not null").select("chunk_id")
    return corpus.by_ids(chunks(spark, d), ids).select("chunk_id", F.length("content").cast("bigint").alias("chars"))


@query(_S + ", n AS (SELECT chunk_id, any_value(caption) AS caption, any_value(caption_status) AS caption_status FROM ingest WHERE caption_status = 'ocr' GROUP BY 1) SELECT s.chunk_id, md5(coalesce(n.caption, s.content)) AS content_md5, coalesce(n.caption_status, s.caption_status) AS caption_status FROM s LEFT JOIN n USING (chunk_id)")
def upserted_chunks(spark, d):
    """The store with captioned image chunks written over."""
    old = chunks(spark, d).select("chunk_id", "content", "caption_status")
    new = table(spark, d, "ingest").where("caption_status = 'ocr'").select("chunk_id", F.col("caption").alias("content"), "caption_status")
    return corpus.upsert(old, new.join(old.select("chunk_id"), "chunk_id", "left_semi")).select("chunk_id", F.md5("content").alias("content_md5"), "caption_status")


@query(_S + "SELECT chunk_id FROM s WHERE NOT (doc_id IN (SELECT doc_id FROM incoming WHERE doc_id IS NOT NULL) AND chunk_type IS DISTINCT FROM 'image')")
def store_without_text(spark, d):
    """The store once the text of documents that came in again is taken out, images kept."""
    return corpus.without_text_of(chunks(spark, d), table(spark, d, "incoming")).select("chunk_id")


@query(_S + "SELECT chunk_id FROM s WHERE doc_id NOT IN (SELECT doc_id FROM seen WHERE status = 'empty' AND doc_id IS NOT NULL)")
def store_without_documents(spark, d):
    """The store without documents recorded as empty."""
    return corpus.without_documents(chunks(spark, d), table(spark, d, "seen").where("status = 'empty'")).select("chunk_id")


@query(_S + "SELECT i.doc_id, coalesce(n, 0) AS deleted FROM (SELECT DISTINCT doc_id FROM incoming WHERE doc_id IS NOT NULL) i LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY 1) c ON c.doc_id = i.doc_id")
def deletion_counts(spark, d):
    """How many chunks go with each document that came in again."""
    return corpus.deleted_counts(chunks(spark, d), table(spark, d, "incoming"))


@query(_S + ", m AS (SELECT doc_id, min(coalesce(nullif(trim(substr(trim(regexp_extract(relpath, '^(.*)/[^/]*$', 1)), 1, 64)), ''), 'General')) AS folder FROM seen WHERE doc_id IS NOT NULL GROUP BY 1) SELECT chunk_id, coalesce(m.folder, s.folder) AS folder FROM s LEFT JOIN m USING (doc_id)")
def moved_chunks(spark, d):
    """Chunks in the folder that the manifest has for their document."""
    m = table(spark, d, "seen").where("doc_id is not null").groupBy("doc_id").agg(F.min(T.clean_folder(T.folder_of(F.col("relpath")))).alias("folder"))
    return corpus.moved(chunks(spark, d), m).select("chunk_id", "folder")


@query(_S + "SELECT chunk_id, split_part(chunk_id, '_', 1) || '_' || page || '_' || chunk_index = chunk_id AS well_formed, regexp_matches(doc_id, '^[0-9a-f]{16}$') AS id_ok, CASE WHEN chunk_index <= -100 THEN -100 - chunk_index END AS figure FROM s")
def chunk_ids(spark, d):
    """Parts of chunk ids, valid document ids, figure numbers."""
    return chunks(spark, d).select("chunk_id", (T.chunk_id(F.col("doc_id"), F.col("page"), F.col("chunk_index")) == F.col("chunk_id")).alias("well_formed"), T.is_doc_id(F.col("doc_id")).alias("id_ok"), T.figure_number(F.col("chunk_index")).alias("figure"))


# -- files and manifest ------------------------------------------------------------------
_JUNK = files.JUNK_FILES.replace("'", "''")
_VERDICT = f"""CASE WHEN list_bool_or([x IN ('@eaDir', '@Recycle', '#recycle', '$RECYCLE.BIN', 'System Volume Information', '@Recently-Snapshot', '@Snapshot') OR starts_with(x, '.') FOR x IN string_split(relpath, '/')[:-2]]) OR regexp_matches(string_split(relpath, '/')[-1], '{_JUNK}') THEN 'excluded'
 WHEN lower(regexp_extract(relpath, '\\.([^./\\\\]+)$', 1)) NOT IN ('pdf', 'docx', 'pptx', 'txt', 'csv') THEN 'unsupported' WHEN size > 104857600 THEN 'oversized' ELSE 'ok' END"""
_VERDICT = _VERDICT.replace("[x IN (", "[(x IN (").replace("starts_with(x, '.') FOR", "starts_with(x, '.')) FOR")


@query(f"SELECT verdict, count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM (SELECT size, {_VERDICT} AS verdict FROM (SELECT relpath, size FROM seen UNION ALL SELECT relpath, size FROM incoming)) GROUP BY 1")
def scan_counts(spark, d):
    """Files of the scans by what becomes of them."""
    both = table(spark, d, "seen").select("relpath", "size").unionAll(table(spark, d, "incoming").select("relpath", "size"))
    return files.scan_counts(files.classify(both))


@query("SELECT doc_id, CASE WHEN coalesce(n_chars, 0) = 0 THEN 'empty' WHEN n_chars > 104857600 THEN 'too large' WHEN coalesce(lower(regexp_extract(filename, '\\.([^./\\\\]+)$', 1)), '') NOT IN ('pdf', 'docx', 'pptx', 'txt', 'csv') THEN 'unsupported' END AS reject_reason FROM documents")
def upload_check(spark, d):
    """Uploads with the reason for a rejection."""
    f = table(spark, d, "documents").select("doc_id", "filename", F.col("n_chars").alias("size"))
    return files.upload_check(f).select("doc_id", "reject_reason")


@query("SELECT relpath, coalesce(nullif(substr(regexp_extract(relpath, '^(.*)/[^/]*$', 1), 1, 64), ''), 'General') AS folder, string_split(relpath, '/')[-1] AS name FROM (SELECT DISTINCT relpath FROM incoming)")
def path_parts(spark, d):
    """Folder and name of each path."""
    return table(spark, d, "incoming").select("relpath").distinct().select("relpath", T.folder_of(F.col("relpath")).alias("folder"), T.basename(F.col("relpath")).alias("name"))


_LATEST = "WITH m AS (SELECT * FROM seen WHERE relpath IS NOT NULL QUALIFY row_number() OVER (PARTITION BY relpath ORDER BY scanned_at DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST, doc_id DESC NULLS LAST, status DESC NULLS LAST) = 1) "


@query(_LATEST + "SELECT scan_id FROM incoming i WHERE relpath IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.relpath = i.relpath AND m.size = i.size AND abs(m.mtime - i.mtime) <= 1e-3)")
def new_files(spark, d):
    """Files that the manifest doesn't know in their present state."""
    return manifest.new_files(table(spark, d, "incoming"), table(spark, d, "seen")).select("scan_id")


@query(_LATEST + "SELECT count(*) FILTER (m.relpath IS NULL) AS new_files, count(*) FILTER (m.relpath IS NOT NULL) AS unchanged, coalesce(sum(i.size) FILTER (m.relpath IS NULL), 0)::BIGINT AS total_bytes FROM incoming i LEFT JOIN m ON m.relpath = i.relpath AND m.size = i.size AND abs(m.mtime - i.mtime) <= 1e-3 WHERE i.relpath IS NOT NULL")
def scan_preview(spark, d):
    """What a scan would take in."""
    return manifest.preview(table(spark, d, "incoming"), table(spark, d, "seen"))


@query(_LATEST + "SELECT coalesce(status, 'none') AS status, count(*) AS files, count(doc_id) AS with_id FROM m GROUP BY 1")
def manifest_states(spark, d):
    """The manifest's present records by status."""
    return manifest.latest(table(spark, d, "seen")).groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("files"), F.count("doc_id").alias("with_id"))


_IN = "(SELECT relpath, size, mtime, doc_id, 'ok' AS status, found_at AS scanned_at FROM incoming WHERE relpath IS NOT NULL QUALIFY row_number() OVER (PARTITION BY relpath ORDER BY found_at DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST, doc_id DESC NULLS LAST) = 1)"


@query(f"SELECT relpath, size, status FROM seen WHERE relpath NOT IN (SELECT relpath FROM incoming WHERE relpath IS NOT NULL) UNION ALL SELECT relpath, size, status FROM {_IN}")
def manifest_after_scan(spark, d):
    """The manifest with the records of a scan put in."""
    rows = table(spark, d, "incoming").select("relpath", "size", "mtime", "doc_id", F.lit("ok").alias("status"), F.col("found_at").alias("scanned_at"))
    return manifest.record(table(spark, d, "seen"), rows).select("relpath", "size", "status")


# -- text of documents ----------------------------------------------------------------------
_T40 = "array_to_string(string_split(text, chr(10))[1:40], chr(10))"


@query(f"SELECT doc_id, coalesce(nullif(substr(trim(regexp_extract({_T40}, '(?im)^[ \\t]*Title[ \\t]*:[ \\t]*(\\S.*)$', 1)), 1, 120), ''), filename) AS title FROM documents")
def document_titles(spark, d):
    """Title line or file name of each document (F7 of §2.10, K6)."""
    return table(spark, d, "documents").select("doc_id", T.title(F.col("text"), F.col("filename")).alias("title"))


#: Lines as splitlines gives them, in SQL.
_LINES = "(SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\v\\f\\x{85}\\x{2028}\\x{2029}]') AS l FROM documents WHERE text IS NOT NULL))"


@query(f"SELECT doc_id, md5(array_to_string([x FOR x IN l IF NOT regexp_matches(x, '^\\s*\\d{{4}}-\\d{{2}}-\\d{{2}}[\\sT]\\d{{2}}:\\d{{2}}:\\d{{2}}')], chr(10))) AS text_md5 FROM {_LINES}")
def telemetry_filtered(spark, d):
    """Texts without time-stamped lines."""
    src = table(spark, d, "documents").where("text is not null")
    return src.select("doc_id", F.md5(T.without_telemetry(F.col("text"))).alias("text_md5"))


_KV = r"'^\s\s(\w[\w ()/-]{2,40}?)\s{3,}([\d.]+)\s+(.+?)\s*$'"


@query(f"""WITH l AS (SELECT doc_id, filename, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, string_agg(trim(regexp_extract(line, {_KV}, 1)) || ': ' || regexp_extract(line, {_KV}, 2) || ' ' || regexp_extract(line, {_KV}, 3), ' | ' ORDER BY n) AS kv FROM l WHERE regexp_matches(line, {_KV}) GROUP BY 1)
SELECT k.doc_id, coalesce(nullif(substr(trim(regexp_extract({_T40}, '(?im)^[ \\t]*Title[ \\t]*:[ \\t]*(\\S.*)$', 1)), 1, 120), ''), filename) || ' | ' || kv AS text FROM k JOIN documents d ON d.doc_id = k.doc_id""")
def summary_chunks(spark, d):
    """Summary lines from key-value rows."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", T.summary_text(T.title(F.col("text"), F.col("filename")), F.col("text")).alias("text")).where("text is not null")


@query(f"SELECT doc_id, n, regexp_matches(text, '{_VALUE}') AS for_value, regexp_matches(text, '{T.COMPARISON_RE}') AS comparison, regexp_matches(text, '{T.CATALOG_RE}') AS catalog, list_distinct(regexp_extract_all(text, '{T.SUBSYSTEM}', 1)) IS NOT NULL AND len(regexp_extract_all(text, '{T.SUBSYSTEM}', 1)) > 0 AS names_subsystem FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS n FROM {_LINES})")
def question_intents(spark, d):
    """What kind of question each line of each document would be."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("n", "text"))
    q = F.col("text")
    return t.select("doc_id", F.col("n").cast("bigint").alias("n"), T.is_value_question(q).alias("for_value"), T.is_comparison(q).alias("comparison"), T.is_catalog_question(q).alias("catalog"), (F.size(T.subsystem_names(q)) > 0).alias("names_subsystem"))


@query()
def chunked_documents(spark, d):
    """Overlapping chunks of every document, with table tags."""
    p = table(spark, d, "documents").where("text is not null").select("doc_id", F.lit(1).alias("page"), "text")
    return chunking.tag_tables(chunking.split_pages(p), p).select("doc_id", "page", "chunk_index", F.md5("text").alias("text_md5"), F.length("text").alias("chars"), "table_id")


@query("SELECT l_orderkey, '| line | part | quantity |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_quantity::BIGINT || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_quantity) AS markdown FROM lineitem GROUP BY 1")
def markdown_tables(spark, d):
    """Each order's lines as a markdown table."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("q")))), lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), x["q"].cast("string")))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(cells.alias("c"))
    return g.select("l_orderkey", T.markdown_table(F.concat(F.array(F.array(F.lit("line"), F.lit("part"), F.lit("quantity"))), F.col("c"))).alias("markdown"))


@query("SELECT vec_id, CASE WHEN len([w FOR w IN regexp_split_to_array(trim(caption), '\\s+') IF w <> '']) >= 10 THEN 'ocr' ELSE 'pending' END AS status FROM ingest WHERE caption_status IS NOT NULL")
def caption_records(spark, d):
    """Captions of at least ten words; others are pending."""
    i = table(spark, d, "ingest").where("caption_status is not null").select("vec_id", "chunk_id", "page", "caption", F.col("doc_id"), F.coalesce("img_idx", F.lit(0)).alias("img_idx"))
    # Rows of one page and figure stand for different figures here, so the row's own id is the document.
    r = chunking.image_chunks(i.select(F.col("vec_id").alias("doc_id"), "page", "img_idx", "caption"))
    return r.select(F.col("doc_id").alias("vec_id"), F.col("caption_status").alias("status"))


# -- conversations and answers -------------------------------------------------------------------
_CONV = "WITH c AS (SELECT user_id AS conv_id, event_id AS turn, ts, CASE WHEN event_type IN ('view', 'click') THEN 'user' ELSE 'assistant' END AS role, event_type || ' ' || props AS text, value FROM events) "


def conversations(spark, d):
    e = table(spark, d, "events")
    role = F.when(F.col("event_type").isin("view", "click"), "user").otherwise("assistant")
    return e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), "ts", role.alias("role"), F.concat_ws(" ", "event_type", "props").alias("text"), "value")


@query(_CONV + "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c QUALIFY back <= 6")
def last_messages(spark, d):
    """The last six messages of every conversation."""
    return answers.last_messages(conversations(spark, d)).select("conv_id", "turn", "back")


@query(_CONV + "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_user FROM c")
def previous_user_turns(spark, d):
    """Each message with the user's message before it."""
    return answers.previous_user_turn(conversations(spark, d)).select("conv_id", "turn", "previous_user")


@query(_CONV + "SELECT conv_id FROM (SELECT conv_id, min(turn) AS first_seen FROM c GROUP BY 1) ORDER BY first_seen DESC, conv_id DESC LIMIT 200")
def kept_sessions(spark, d):
    """The 200 sessions begun last (V12): a top-k report."""
    return answers.newest_sessions(conversations(spark, d), 200, at="turn").select("conv_id")


@query(_CONV + "SELECT conv_id, count(*) AS runs, round(median(value), 6) AS ttft, round(median(value * 2), 6) AS total, round(avg(CASE WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END), 6) AS refusal_rate, round(CASE WHEN count(nullif(value, 0)) >= 2 AND avg(nullif(value, 0)) <> 0 THEN stddev_pop(nullif(value, 0)) / avg(nullif(value, 0)) ELSE 0 END, 6) AS cv FROM c GROUP BY 1")
def run_statistics(spark, d):
    """Medians, refusal rate and variation by group."""
    runs = conversations(spark, d).select("conv_id", F.col("value").alias("ttft"), (F.col("value") * 2).alias("total"), F.col("value").alias("tok_s"), (F.col("role") == "assistant").alias("refused"))
    r = answers.run_statistics(runs, ["conv_id"])
    return r.select("conv_id", "runs", F.round("ttft", 6).alias("ttft"), F.round("total", 6).alias("total"), F.round("refusal_rate", 6).alias("refusal_rate"), F.round("cv", 6).alias("cv"))


@query("""WITH r AS (SELECT l_partkey AS g, l_orderkey AS run, list_distinct(list(l_suppkey)) AS vals FROM lineitem GROUP BY 1, 2),
n AS (SELECT g, count(*) AS n FROM r GROUP BY 1), v AS (SELECT g, v, count(*) AS c FROM (SELECT g, run, unnest(vals) AS v FROM r) GROUP BY 1, 2)
SELECT n.g AS l_partkey, round(CASE WHEN n >= 2 THEN 1 - count(*) FILTER (c = n)::DOUBLE / count(*) ELSE 0 END, 6) AS drift FROM n JOIN v ON v.g = n.g GROUP BY n.g, n""")
def answer_drift(spark, d):
    """How many of the values of a group's runs are not in all of them (A15, U3): the suppliers of a part over its orders."""
    runs = table(spark, d, "lineitem").groupBy("l_partkey", F.col("l_orderkey").alias("run")).agg(F.collect_set("l_suppkey").alias("values")).withColumn("refused", F.lit(False))
    return answers.drift(runs, ["l_partkey"]).select("l_partkey", F.round("drift", 6).alias("drift"))


@query("SELECT event_id, greatest(0, least(CAST(floor(value) AS INT), len(string_split(props, '\"')) - 1)) AS step FROM events")
def step_positions(spark, d):
    """Wanted steps clamped to those there are."""
    e = table(spark, d, "events")
    return e.select("event_id", T.clamp_step(F.floor("value").cast("int"), F.split("props", '"')).alias("step"))


# -- quantities -------------------------------------------------------------------------------
@query()
def p2_found(spark, d):
    """Readings of the listed quantities in text and summary chunks, in the common unit, as integers."""
    c = table(spark, d, "store").where("chunk_type is null").select("chunk_id", "content")
    return units.reading_integers(c, table(spark, d, "quantities"))


# -- more of the inventory ----------------------------------------------------------------------
@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_id FROM documents WHERE text IS NOT NULL AND substr(sha256(text), 1, 16) NOT IN (SELECT doc_id FROM seen WHERE doc_id IS NOT NULL)")
def unknown_contents(spark, d):
    """Documents whose content hash the manifest doesn't have."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", T.content_id(F.encode("text", "UTF-8")).alias("content_id"))
    return docs.join(table(spark, d, "seen").select(F.col("doc_id").alias("content_id")).where("content_id is not null").distinct(), "content_id", "left_anti").select("doc_id", "content_id")


@query("SELECT text, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS text FROM documents WHERE text IS NOT NULL) WHERE text <> '' AND NOT starts_with(text, '#') GROUP BY 1")
def question_lines(spark, d):
    """Lines that are neither blank nor comments, as a question file has them."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("text"))
    return lines.where("text <> '' and not startswith(text, '#')").groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(_S + "SELECT chunk_id, row_number() OVER (PARTITION BY doc_id, page ORDER BY chunk_index DESC) - 1 AS img_idx FROM s WHERE chunk_type = 'image'")
def image_numbers(spark, d):
    """Images numbered within their page."""
    i = chunks(spark, d).where("chunk_type = 'image'").select("chunk_id", "doc_id", "page", (-F.col("chunk_index")).alias("pos"), F.col("chunk_id").alias("ref"), F.lit(6000).alias("size"))
    return chunking.number_images(i).select("chunk_id", "img_idx")


@query("WITH r AS (SELECT user_id, median(value) AS ttft, median(value * 2) AS total, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS refusal FROM events GROUP BY 1) SELECT user_id, row_number() OVER (ORDER BY round(total, 6), user_id) AS place FROM r")
def benchmark_report(spark, d):
    """Groups of runs in the order of a report."""
    e = table(spark, d, "events").select("user_id", F.col("value").alias("ttft"), (F.col("value") * 2).alias("total"), F.col("value").alias("tok_s"), (F.col("event_type") == "error").alias("refused"))
    r = answers.run_statistics(e, ["user_id"])
    return answers.placed(r, F.round("total", 6), "user_id").select("user_id", "place")


@query("SELECT status, files, total_bytes, row_number() OVER (ORDER BY files DESC, status) AS place FROM (SELECT coalesce(status, 'none') AS status, count(*) AS files, sum(size)::BIGINT AS total_bytes FROM seen GROUP BY 1)")
def job_progress(spark, d):
    """Counters of a job by outcome."""
    g = table(spark, d, "seen").groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("files"), F.sum("size").alias("total_bytes"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("files"), "status")))


_ASK = procedure.ASK.replace("\n", "' || chr(10) || '")


@query(_S + f""", c AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY page, chunk_index, chunk_id) AS n FROM s WHERE doc_id IS NOT NULL AND chunk_index >= 0 AND coalesce(chunk_type, '') <> 'image' AND content IS NOT NULL),
g AS (SELECT doc_id, md5(p) AS h FROM (SELECT doc_id, '{_ASK}' || string_agg(content, chr(10) || chr(10) ORDER BY n) AS p FROM c WHERE n <= 20 GROUP BY 1) WHERE length(p) % 2 = 0)
SELECT doc_id, 1::BIGINT AS step, md5('1. ' || h) AS text_md5 FROM g UNION ALL SELECT doc_id, 2, md5('2. end') FROM g
UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n), md5(trim(content)) FROM c WHERE trim(content) <> '' AND doc_id NOT IN (SELECT doc_id FROM g)""")
def procedure_steps(spark, d):
    """Every document as numbered steps: those that a stand-in for the generator gives for every other document, the chunks of the rest (K6, K8, M8)."""
    write = lambda p: F.when(F.length(p) % 2 == 0, F.concat(F.lit("Steps:\n 1. "), F.md5(p), F.lit("\n2. end\nDone."))).otherwise("no steps")
    return procedure.steps(table(spark, d, "store"), write).select("doc_id", "step", F.md5("text").alias("text_md5"))


@query(_S + """, h AS (SELECT doc_id, arg_min({'f': filename, 'o': folder}, (page, chunk_index, chunk_id)) AS h FROM s WHERE chunk_index IN (-1, 0) AND doc_id NOT IN (SELECT doc_id FROM incoming WHERE doc_id IS NOT NULL) GROUP BY 1),
i AS (SELECT doc_id, page, coalesce(img_idx, 0) AS n, arg_max({'c': caption, 's': caption_status}, vec_id) AS x FROM ingest WHERE caption_status IS NOT NULL GROUP BY 1, 2, 3)
SELECT i.doc_id || '_' || page || '_' || (-100 - n) AS chunk_id, x.s AS caption_status, md5('[' || h.f || '] [Figure on page ' || page || ']: ' || coalesce(x.c, '(uncaptioned figure — pending vision pass)')) AS content_md5 FROM i JOIN h ON h.doc_id = i.doc_id""")
def late_figures(spark, d):
    """Image chunks that come after the text, once the documents of incoming were deleted meanwhile (J18, late enrichment)."""
    left = corpus.without_documents(chunks(spark, d), table(spark, d, "incoming"))
    heads = corpus.documents(left).select("doc_id", F.col("filename").alias("title"), "filename", "folder")
    i = table(spark, d, "ingest").where("caption_status is not null").groupBy("doc_id", "page", F.coalesce("img_idx", F.lit(0)).alias("n")).agg(F.max_by(F.struct("caption", "caption_status"), "vec_id").alias("x"))
    late = corpus.figures(i.select("doc_id", "page", (-100 - F.col("n")).alias("chunk_index"), "x.caption", "x.caption_status"), heads)
    return corpus.still_there(late, left).select("chunk_id", "caption_status", F.md5("content").alias("content_md5"))


@query("SELECT DISTINCT relpath FROM seen WHERE lower(regexp_extract(relpath, '\\.([^./\\\\]+)$', 1)) IN ('pdf', 'docx', 'pptx', 'txt', 'csv')")
def reindex_list(spark, d):
    """The files that a rebuild takes in."""
    return files.to_reindex(table(spark, d, "seen").select("relpath").distinct())


@query("SELECT scan_id FROM incoming WHERE found_at >= (SELECT max(found_at) FROM incoming) - INTERVAL 7200 SECOND")
def live_scans(spark, d):
    """What is kept of scans two hours after they began, at the time of the last one (state TTL)."""
    i = table(spark, d, "incoming")
    last = i.agg(F.max("found_at").alias("now")).first().now
    return answers.live(i, F.lit(last), at="found_at").select("scan_id")


@query("SELECT doc_id, length('search_document: ' || text) AS chars, length('search_document: ' || text) - length(replace('search_document: ' || text, ' ', '')) AS blanks FROM documents WHERE text IS NOT NULL")
def embedded_documents(spark, d):
    """What an embedding model is shown of each document: a stand-in that counts (M1)."""
    vec = models.embedder(lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts])
    r = table(spark, d, "documents").where("text is not null").select("doc_id", vec(F.col("text")).alias("v"))
    return r.select("doc_id", F.col("v")[0].cast("bigint").alias("chars"), F.col("v")[1].cast("bigint").alias("blanks"))


@query("SELECT doc_id, length(text)::VARCHAR || ' characters' AS reply FROM documents")
def model_replies(spark, d):
    """A reply to each document by a stand-in for the generator; none where there is no text (M2)."""
    reply = models.generator(lambda prompts: [f"{len(p)} characters" for p in prompts])
    return table(spark, d, "documents").select("doc_id", reply(F.col("text")).alias("reply"))


# -- blocks, variants, reports ---------------------------------------------------------------------
@query("WITH e AS (SELECT relpath FROM seen WHERE status = 'error' AND relpath IS NOT NULL) SELECT row_number() OVER (ORDER BY relpath) AS pos, relpath AS message FROM (SELECT relpath FROM e ORDER BY relpath LIMIT 200) UNION ALL SELECT 201, '... and ' || (n - 200) || ' more errors' FROM (SELECT count(*) AS n FROM e) WHERE n > 200")
def error_report(spark, d):
    """The first 200 errors of a scan and how many more there are (K9): a report's length."""
    e = table(spark, d, "seen").where("status = 'error' and relpath is not null").select("relpath", F.col("relpath").alias("message"))
    return manifest.capped_errors(e, 200)


@query("SELECT relpath, size, status FROM seen WHERE relpath NOT IN (SELECT relpath FROM incoming WHERE relpath IS NOT NULL)")
def manifest_without(spark, d):
    """The manifest once paths that came in again are forgotten."""
    return manifest.forget(table(spark, d, "seen"), table(spark, d, "incoming").where("relpath is not null")).select("relpath", "size", "status")


@query("""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS block, l_quantity::DOUBLE AS size, l_returnflag = 'R' AS bold, repeat(l_partkey::VARCHAR, 10) AS text FROM lineitem),
b AS (SELECT doc_id, list_sort(list(size))[count(*) // 2 + 1] AS body FROM p GROUP BY 1)
SELECT p.doc_id, block, any_value(body) AS body, (sum(length(text)) <= 150 AND avg(size) >= 1.15 * any_value(body)) OR (sum(length(text)) <= 80 AND bool_and(bold)) AS is_heading FROM p JOIN b ON b.doc_id = p.doc_id GROUP BY 1, 2""")
def heading_blocks(spark, d):
    """Body size of a page and its heading blocks (S5, S6): order lines stand for spans, quantities for font sizes."""
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_linenumber") % 3).alias("block"), F.col("l_quantity").cast("double").alias("size"), (F.col("l_returnflag") == "R").alias("bold"), F.repeat(F.col("l_partkey").cast("string"), 10).alias("text"))
    return chunking.heading_blocks(p).join(chunking.body_size(p).withColumnRenamed("size", "body"), ["doc_id", "page"]).select("doc_id", "block", "body", "is_heading")


_HEAD = "^[A-Z0-9][A-Za-z0-9 -]{2,40}$"


@query(f"""WITH b AS (SELECT doc_id, n, text, regexp_matches(text, '{_HEAD}') AS h FROM (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS n FROM {_LINES}) WHERE trim(text) <> ''),
c AS (SELECT *, last_value(CASE WHEN h THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading, coalesce(lead(h) OVER (PARTITION BY doc_id ORDER BY n), true) AS next_h FROM b)
SELECT doc_id, n, md5(CASE WHEN h OR heading IS NULL THEN text ELSE heading || chr(10) || text END) AS text_md5 FROM c WHERE NOT h OR next_h""")
def carried_headings(spark, d):
    """Lines of documents behind the heading above them (V5): short lines without marks stand for headings."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "text")).where(F.trim("text") != "")
    r = chunking.carry_headings(t.withColumn("is_heading", F.col("text").rlike(_HEAD)))
    return r.select("doc_id", F.col("pos").cast("bigint").alias("n"), F.md5("text").alias("text_md5"))


@query("SELECT doc_id, generate_subscripts(v, 1) - 1 AS variant, md5(unnest(v)) AS text_md5 FROM (SELECT doc_id, [text] || list_filter([trim(x) FOR x IN string_split(text, chr(10))], lambda x: x <> '')[1:3] AS v FROM documents WHERE text IS NOT NULL)")
def question_variants(spark, d):
    """A text with at most three lines of what an expander gives for it: here the text's own lines (M5)."""
    q = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("q_id"), "text")
    return retrieval.variants(q, lambda t: t).select(F.col("q_id").alias("doc_id"), F.col("variant").cast("bigint").alias("variant"), F.md5("text").alias("text_md5"))


@query(_CONV + ", l AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user' AND text <> '') AS last, arg_max(text, turn) AS asked FROM c GROUP BY 1) SELECT conv_id, CASE WHEN last IS NULL OR last = asked THEN asked ELSE last || ' ' || asked END AS text FROM l")
def questions_with_history(spark, d):
    """Each conversation's last message with the user's last turn before it, unless that is the same (V11, J of history)."""
    c = conversations(spark, d)
    q = c.groupBy(F.col("conv_id").alias("q_id")).agg(F.max_by("text", "turn").alias("text"))
    return retrieval.augmented(q, c.select(F.col("conv_id").alias("q_id"), "turn", "role", "text")).select(F.col("q_id").alias("conv_id"), "text")


@query(r"SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE regexp_matches(line, '^\d+\.\s+.+$') GROUP BY 1, 2")
def numbered_lines(spark, d):
    """Numbered lines of documents, as a reply with steps has them (M8)."""
    t = table(spark, d, "documents").select("doc_id", F.explode(T.step_lines(F.col("text"))).alias("line"))
    return t.groupBy("doc_id", "line").agg(F.count("*").alias("n"))


_LABEL = r"(?i:Table\s+\d+\b)"


@query(_S + f"""SELECT * FROM (WITH t AS (SELECT chunk_id, regexp_split_to_array(content, '{_LABEL}') AS p, regexp_extract_all(content, '{_LABEL}') AS l FROM s WHERE regexp_matches(content, '{_LABEL}')),
r AS (SELECT chunk_id, i, length(p[1]) AS lead, l[i] || p[i + 1] AS part FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM t)),
x AS (SELECT chunk_id, i, lead + coalesce(sum(length(part)) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, part, CASE WHEN regexp_matches(part, '\n\n[A-Z][a-z]') THEN length(regexp_extract(part, '(?s)^(.*?)\n\n[A-Z][a-z]', 1)) END AS prose FROM r)
SELECT chunk_id, i - 1 AS n, start::BIGINT AS first, (start + CASE WHEN prose > 80 THEN prose ELSE length(part) END)::BIGINT AS stop FROM x)""")
def table_spans(spark, d):
    """Where labelled tables begin and end, each chunk taken as a page."""
    p = chunks(spark, d).select(F.col("chunk_id").alias("doc_id"), F.lit(1).alias("page"), F.col("content").alias("text"))
    return chunking.table_spans(p).select(F.col("doc_id").alias("chunk_id"), F.col("n").cast("bigint").alias("n"), F.col("start").cast("bigint").alias("first"), F.col("end").cast("bigint").alias("stop"))
