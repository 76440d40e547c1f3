"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from ..runtime import table
from . import encoding, history, knn, mixing, neardup, packing, scans


def p1_found(spark, d):
    """Rows of incoming that repeat a row of seen or an earlier row of incoming, batch by batch."""
    past = history.History(spark, kinds=("files",)).accept(table(spark, d, "seen"))
    found = history.in_batches(past, table(spark, d, "incoming"), "scan_id", "batch_no")
    past.drop()
    return found.withColumnRenamed("pos", "scan_id")


def p1_coverage(spark, d):
    """Leading folders of each incoming path, and how many of them hold accepted files."""
    return history.coverage(table(spark, d, "incoming"), table(spark, d, "seen"))


def p3_found(spark, d):
    """Pairs at least 0.88 similar, one among the five most similar of the other."""
    return knn.similar_pairs(table(spark, d, "ingest"))


def p3_topk(spark, d):
    """The five most similar vectors of every vector whose id is divisible by 50, however far they are."""
    v = table(spark, d, "ingest")
    asked = v.where("vec_id % 50 = 0").select(v.vec_id.alias("q"))
    near = knn.top_k(v, k=5, queries=asked, projections=4, tables=4, probes=16)
    return near.select("q", "n", knn.F.round("sim", 6).alias("sim"), "rank")


def _text_chunks(spark, d):
    return table(spark, d, "store").where("chunk_type is null and chunk_index >= 0").select("chunk_id", "content")


def p4_found(spark, d):
    """Pairs of text chunks whose bags of words are at least 0.8 similar."""
    return neardup.pairs(_text_chunks(spark, d))


def p5_found(spark, d):
    """Distinct scan defects: divided words, misread characters, headers, page numbers."""
    return scans.found(table(spark, d, "store"), table(spark, d, "ingest"), table(spark, d, "lexicon"))


def p5_repaired(spark, d):
    """All texts as continuous paragraphs without page furniture."""
    return scans.repaired(table(spark, d, "store"), table(spark, d, "ingest"), table(spark, d, "lexicon"))


def p4_classes(spark, d):
    """Each text chunk with its class of copies and the number of linked classes."""
    return neardup.classes(_text_chunks(spark, d))


def p6_packing(spark, d):
    """Where each document goes for each capacity."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_report(spark, d):
    """Containers used, their fill and how near their documents are, for each capacity."""
    boxes = table(spark, d, "containers")
    return packing.report(packing.pack(table(spark, d, "documents"), boxes, keys=True), boxes)


def p7_mix(spark, d):
    """Documents drawn for each mix, in the order of their training positions."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_report(spark, d):
    """Target and actual shares of each source of each mix."""
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark, d):
    """Documents with wrongly decoded characters and the length of their restored text."""
    return encoding.found(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_coverage, p3_found, p3_topk, p4_found, p4_classes, p5_found, p5_repaired, p6_packing, p6_report, p7_mix, p7_report, p8_found)}
SQL: dict[str, str] = {}

SQL["p1_coverage"] = r"""
WITH f AS (SELECT 0 AS scan_id, true AS old, string_split(regexp_replace(lower(relpath), '[/\\]+', '/', 'g'), '/') AS p FROM seen
           UNION ALL SELECT scan_id, false, string_split(regexp_replace(lower(relpath), '[/\\]+', '/', 'g'), '/') FROM incoming),
x AS (SELECT scan_id, old, array_to_string(p[1:i], '/') AS part FROM f, range(1, 64) r(i) WHERE i < len(p)),
k AS (SELECT DISTINCT part FROM x WHERE old)
SELECT scan_id, count(*) AS parts, count(k.part) AS known FROM x LEFT JOIN k USING (part) WHERE NOT old GROUP BY scan_id
"""
