"""Queries of the operators of this package, over whole tables with production parameters."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbita.functions.runtime import table
from orbita.llm.bpe import token_counts, token_ids
from orbita.llm.copies import copy_classes
from orbita.llm.mixture import draw_mixture
from orbita.llm.near import near_groups, near_pairs
from orbita.llm.topn import top_n
from orbita.llm.visual import LOOK_ALIKES, _parts, look_alike_pairs, visual_form


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return top_n(table(spark, sf, "candidates"), ["run_id", "engine"], "score", "id", 5)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return copy_classes(table(spark, sf, "candidates"), "id", "source").where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    """One candidate per distinct source, with the number of its copies."""
    return copy_classes(table(spark, sf, "candidates"), "id", "source").where("id = first_id").select("id", "copies")


def _left_out(rows: DataFrame) -> DataFrame:
    """Only the first of each group of copies takes part; who takes no part there takes none here either."""
    copies = copy_classes(rows, "id", "source").where("id <> first_id").select("id")
    return copies.unionByName(rows.where(~F.coalesce(F.col("source").rlike("[A-Za-z0-9]"), F.lit(False))).select("id"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "candidates")
    return near_pairs(rows, "id", ["source", "source_diff"], leave_out=_left_out(rows), width=3)


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Of each candidate with a near-duplicate: its group (smallest id) and its number of links."""
    rows = table(spark, sf, "candidates")
    return near_groups(rows, "id", ["source", "source_diff"], leave_out=_left_out(rows), width=3)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids(table(spark, sf, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    counted = token_counts(docs.select(F.struct("doc_id", "source").alias("doc"), "text"), "doc", "text")
    return draw_mixture(counted.select("doc.doc_id", "doc.source", "n_tokens"), table(spark, sf, "mix_targets"))


def p7_draw(spark: SparkSession, sf: str) -> DataFrame:
    """The documents drawn and how often."""
    return _mixture(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixture(spark, sf)[1]


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf, "documents"), "doc_id", "text")


def p8_form(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in its one form."""
    return visual_form(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "form")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_records, p5_found, p5_groups, p6_ids, p7_draw, p7_shares, p8_found, p8_form)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = f"regexp_replace({_LOWER}, '[^a-z0-9]', '', 'g')"

#: Key of each source: letters and digits, or of a JSON object its values under their paths.
_COPIES = f"""o AS (SELECT id, source, CASE WHEN json_valid(source) AND ltrim(source, chr(32) || chr(9) || chr(10) || chr(13)) LIKE '{{%' THEN source END AS j FROM candidates WHERE source IS NOT NULL),
    x AS (SELECT o.id, regexp_replace({_LOWER.format('t.fullkey')}, '[^a-z0-9.\\[\\]$]', '', 'g') AS p, CASE WHEN t.type IN ('OBJECT', 'ARRAY') THEN t.type ELSE {_PLAIN.format("coalesce(t.atom ->> '$', 'null')")} END AS v FROM o, json_tree(o.j) t WHERE o.j IS NOT NULL),
    f AS (SELECT id, '{{' || string_agg(p || '=' || v, ',' ORDER BY p, v) AS form FROM x GROUP BY id),
    k AS (SELECT o.id, coalesce(f.form, {_PLAIN.format('o.source')}) AS key FROM o LEFT JOIN f ON f.id = o.id WHERE {_PLAIN.format('o.source')} <> ''),
    c AS (SELECT id, min(id) OVER (PARTITION BY key) AS first_id, count(*) OVER (PARTITION BY key) AS copies FROM k)"""

_NEAR = f"""{_COPIES}, d AS (SELECT id, unnest(['source', 'source_diff']) AS field, unnest([source, source_diff]) AS text FROM candidates WHERE id IN (SELECT id FROM c WHERE id = first_id)),
    w AS (SELECT id, field, regexp_extract_all({_LOWER.format('text')}, '[a-z0-9_]+') AS w FROM d WHERE text IS NOT NULL),
    s AS (SELECT DISTINCT field, id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS t FROM w WHERE len(w) >= 3),
    n AS (SELECT field, id, count(*) AS n FROM s GROUP BY field, id), r AS (SELECT field, t FROM s GROUP BY field, t HAVING count(*) > 1), z AS (SELECT s.* FROM s JOIN r USING (field, t)),
    b AS (SELECT a.field, a.id AS id_a, b.id AS id_b, count(*) AS hits FROM z a JOIN z b ON a.field = b.field AND a.t = b.t AND a.id < b.id GROUP BY ALL),
    p AS (SELECT b.field, id_a, id_b FROM b JOIN n x ON x.field = b.field AND x.id = id_a JOIN n y ON y.field = b.field AND y.id = id_b WHERE 5 * hits >= 4 * (x.n + y.n - hits))"""



def _form_sql(text: str) -> str:
    """SQL of the one form of a text: characters that become one other or none by translation, those that become several by
    replacement, then composition by the database. The look-alikes are the fixed ones."""
    one, gone, several = [], [], []
    for cp in range(1, 0x30000):
        ch = chr(cp)
        if ch in "\r\n\t" or 0xD800 <= cp <= 0xF8FF or 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        to = unicodedata.normalize("NFC", "".join(map(chr, _parts(cp, LOOK_ALIKES))))
        if to == unicodedata.normalize("NFC", ch):
            continue
        (gone if not to else one if len(to) == 1 else several).append((ch, to))
    text = f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for ch, to in several:
        text = f"replace({text}, '{ch}', '{to}')"
    quoted = lambda chars: "'" + "".join(chars).replace("'", "''") + "'"
    return f"nfc_normalize(translate({text}, {quoted([c for c, _ in one + gone])}, {quoted([t for _, t in one])}))"


SQL = {
    "p8_form": f"SELECT doc_id, {_form_sql('text')} AS form FROM documents",
    "p8_found": f"""WITH f AS (SELECT doc_id, text, {_form_sql('text')} AS form FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text WHERE trim(translate(a.form, chr(9) || chr(10), '  ')) <> ''""",
    "p3_found": f"WITH {_COPIES} SELECT first_id, id AS copy_id FROM c WHERE id <> first_id",
    "p3_records": f"WITH {_COPIES} SELECT id, copies FROM c WHERE id = first_id",
    "p5_found": f"WITH {_NEAR} SELECT field, id_a, id_b FROM p",
    "p5_groups": f"""WITH RECURSIVE {_NEAR}, e AS (SELECT field, id_a AS id, id_b AS o FROM p UNION ALL SELECT field, id_b, id_a FROM p), g(field, id, o) AS (SELECT field, id, id FROM e UNION SELECT g.field, g.id, e.o FROM g JOIN e ON e.field = g.field AND e.id = g.o),
        l AS (SELECT field, id, min(o) AS group_id FROM g GROUP BY field, id), m AS (SELECT field, id, count(*) AS links FROM e GROUP BY field, id) SELECT l.field, l.id, group_id, links FROM l JOIN m ON l.field = m.field AND l.id = m.id""",
    "p2_found": """
        SELECT run_id, engine, CAST(r AS INTEGER) AS rank_no, id FROM (
          SELECT run_id, engine, id, row_number() OVER (PARTITION BY run_id, engine ORDER BY score + 0.0 DESC, id) AS r
          FROM candidates WHERE score IS NOT NULL AND CAST(score AS VARCHAR) <> 'nan') WHERE r <= 5""",
}
