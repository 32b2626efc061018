"""Queries of the training-text operators over the driver's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernweh.llm import encoding, leaks, lookalikes, mail, markup, neighbours, packing, passages, scans
from fernweh.runtime import materialize, read


def p1_found(spark, d):
    """Passages whose text is over the limit, through the cutter."""
    return passages.split_oversized(read(spark, d, "passages")).select("file", "n").distinct()


def p1_pieces(spark, d):
    """The pieces themselves, placed in the files' texts."""
    return passages.split_oversized(read(spark, d, "passages"), read(spark, d, "texts"), read(spark, d, "content_map"))


def p1_sound(spark, d):
    """Of each oversized passage: whether all pieces are within the limit, there are several, and each has its place."""
    p = passages.split_oversized(read(spark, d, "passages"), read(spark, d, "texts"), read(spark, d, "content_map"))
    own = F.length(passages.body_of(F.col("prompt")))
    return p.groupBy("file", "n").agg((F.max(own) <= passages.MAX_CHARS).alias("within"), (F.count("*") > 1).alias("several"), F.bool_and(F.col("start_pos").isNotNull() & (F.col("end_pos") >= F.col("start_pos"))).alias("placed"))


def p2_found(spark, d):
    """Texts that hold a stretch decoded with a wrong encoding."""
    return encoding.restore(read(spark, d, "texts"), wording=False).select(F.col("id").alias("text_id")).distinct()


def p2_restored(spark, d):
    """Those texts with their wording restored."""
    return encoding.restore(read(spark, d, "texts"))


def p4_found(spark, d):
    """Lines of scans that are furniture, end in a divided word, or hold a misread one."""
    return scans.noise(read(spark, d, "ocr_cache"))


def p4_text(spark, d):
    """The scans' texts as continuous paragraphs."""
    return scans.repaired(read(spark, d, "ocr_cache"))


def p5_found(spark, d):
    """Pairs of vectors of which one is among the five most similar to the other."""
    return neighbours.pairs(read(spark, d, "vectors"))


def p5_nearest(spark, d):
    """The five most similar others of every usable vector."""
    return neighbours.nearest(read(spark, d, "vectors"))


def p6_found(spark, d):
    """Kinds of markup in each text."""
    return markup.kinds(read(spark, d, "texts"))


def p6_clean(spark, d):
    """The texts as clean text."""
    return markup.cleaned(read(spark, d, "texts"))


def p7_found(spark, d):
    """Lines of mails that their senders didn't newly write."""
    return mail.foreign_lines(read(spark, d, "mail_parts"))


def p7_new_text(spark, d):
    """The newly written text of each part."""
    return mail.new_text(read(spark, d, "mail_parts"))


def p8_containers(spark, d):
    """Containers of at most 2,048 tokens and what they hold."""
    return packing.containers(read(spark, d, "documents"))


def p8_sound(spark, d):
    """Of each document: whether its pieces are placed once, one after the other, in containers that hold what they say and no more than fits."""
    c = materialize(packing.containers(read(spark, d, "documents")), "containers")
    full = c.groupBy("container").agg(F.sum("tokens").alias("held"), F.max("fill").alias("said"))
    right = full.select("container", ((F.col("held") == F.col("said")) & (F.col("held") <= packing.CAPACITY)).alias("fits"))
    each = c.join(right, "container").groupBy("doc_id").agg(F.bool_and("fits").alias("fits"), F.count("*").alias("n"), F.countDistinct("piece").alias("d"), F.max("piece").alias("last"), F.sum("tokens").alias("tokens"), F.max(F.col("start_token") + F.col("tokens")).alias("end"))
    return each.select("doc_id", "fits", ((F.col("n") == F.col("d")) & (F.col("n") == F.col("last") + 1) & (F.col("tokens") == F.col("end"))).alias("once"))


def p9_found(spark, d):
    """Documents that hold passages of test items."""
    return leaks.leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p10_found(spark, d):
    """Pairs of documents that are different strings but look the same."""
    return lookalikes.same_look(read(spark, d, "documents"))


def p10_classes(spark, d):
    """The class of each document that looks like a different string."""
    return lookalikes.look_classes(read(spark, d, "documents"))


def p10_stable(spark, d):
    """Whether the form of each document is its own form."""
    docs = read(spark, d, "documents")
    counts = lookalikes.model(docs)
    first = materialize(lookalikes.forms(docs, counts=counts), "forms")
    return first.join(lookalikes.forms(first, column="form", counts=counts).withColumnRenamed("form", "again"), "doc_id").select("doc_id", (F.col("form") == F.col("again")).alias("stable"))


def p10_forms(spark, d):
    """The one form of each document."""
    return lookalikes.forms(read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_sound, p2_found, p2_restored, p4_found, p4_text, p5_found, p5_nearest, p6_found, p6_clean, p7_found, p7_new_text, p8_containers, p8_sound, p9_found, p10_found, p10_classes, p10_stable, p10_forms)}

_USABLE = """u AS MATERIALIZED (SELECT hash, min(vec)::DOUBLE[] AS vec FROM vectors WHERE hash IS NOT NULL AND len(vec) = 128 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0 GROUP BY hash),
    near AS (SELECT hash, other, sim, row_number() OVER (PARTITION BY hash ORDER BY sim DESC, other) AS place FROM (SELECT a.hash, b.hash AS other, round(list_cosine_similarity(a.vec, b.vec), 6) AS sim FROM u a JOIN u b ON a.hash <> b.hash))"""
_OVER = "length(CASE WHEN instr(prompt, chr(10) || chr(10)) > 0 THEN substr(prompt, instr(prompt, chr(10) || chr(10)) + 2) ELSE prompt END) > 1800"

SQL = {
    "p1_sound": f"SELECT DISTINCT file, n, true AS within, true AS several, true AS placed FROM passages WHERE {_OVER}",
    "p5_found": f"WITH {_USABLE} SELECT DISTINCT least(hash, other) AS hash_a, greatest(hash, other) AS hash_b FROM near WHERE place <= 5",
    "p8_sound": "SELECT DISTINCT doc_id, true AS fits, true AS once FROM documents WHERE text <> ''",
    "p10_stable": "SELECT doc_id, true AS stable FROM documents WHERE text IS NOT NULL",
    "p1_found": r"""
        SELECT DISTINCT file, n FROM passages
        WHERE length(CASE WHEN instr(prompt, chr(10) || chr(10)) > 0 THEN substr(prompt, instr(prompt, chr(10) || chr(10)) + 2) ELSE prompt END) > 1800
    """,
}
